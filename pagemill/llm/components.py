"""Connected components of links, by alternating large and small stars in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, rows_of, ship, small_side

#: Links that a task contracts to a forest at a time.
TASK_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of links (a, b) but the least of its component, and that least node."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        on = root[x] != root[y]
        x, y = x[on], y[on]
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _forests(links: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b), a >= b, with the same components: each task makes forests of TASK_LINKS links at a time,
    in which every node stands beside its component's least node."""
    ship(links.sparkSession)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in range(2)])
            n += batch.num_rows
            if n >= TASK_LINKS and tasks > 1:
                yield _batch(held)
                held, n = [], 0
        if n:
            yield _batch(held)

    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def _batch(held: list) -> pa.RecordBatch:
    a, b = forest(*(np.concatenate(x) for x in zip(*held)))
    top = np.unique(b)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, top]), pa.int64()), pa.array(np.concatenate([b, top]), pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of links (a, b). Links are contracted by tasks of
    TASK_LINKS; where one task holds them all, its forests are the answer. Else large and small stars go on
    from the forests: hubs are aggregated before the shuffle, and the number of rounds grows with the
    logarithm of a component's size."""
    links = checkpoint(links.filter("a <> b"))
    n = rows_of(links)
    if n <= TASK_LINKS:
        return checkpoint(_forests(links, 1)).toDF("node", "component")
    edges = checkpoint(_forests(links, -(-n // TASK_LINKS)).filter("a <> b").distinct())
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.filter("a <> m").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.filter("a <> b").distinct())
    out = edges.groupBy("a").agg(F.min("b").alias("b"))
    return out.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links (a, b): only the links' components are solved."""
    of = small_side(labels.select("node", "component"))
    ends = links.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    joined = small_side(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    moved = labels.join(joined.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionAll(joined.join(of.select("node"), "node", "left_anti"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a, b), a > b, has one edge down, or edges up only."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    return ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("up")).filter("n > 1 OR n = 1 AND up = 0").isEmpty()
