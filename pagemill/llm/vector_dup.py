"""Near duplicates of vectors by sorted projection passes.

A pass orders the vectors of each label by a key of concatenated random hashes: the sides of random
hyperplanes, one bit each. Vectors of a small angle mostly have the same key and else stand near each
other in its order. The order is cut, between keys, into neighbour windows of about WINDOW vectors, and
what stands in one window is compared by its cosine in double precision. A single key with more vectors
is a window of its own; it is dealt to parts and each part meets each other, so no window is compared in
part only and no task holds more than two parts. Verified pairs of all passes are united to components.

The number of bits grows with the logarithm of a label's vectors, and the number of passes with the bits:
a pair whose cosine is just the least one has different keys in every pass with probability MISS, and a
closer pair more rarely. Vectors carry the windows of their earlier passes, so a pair that met before is
counted once without a row for a pair: a window gives a row for each vector that has links and the forest
of its links.

Equal vectors of a label are one member, whatever their number. Labels are compared as strings. A vector
that is null, empty or zero, or has a null or non-finite component, or a null label, links with nothing;
nor do vectors of different lengths. Rows that repeat a vec_id are rows of their own, and null vec_ids
link like others but name no component (which is null if it has no other). An empty table gives no rows;
columns beside vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, frequent_join, ship, small_side
from pagemill.llm.components import components, forest

#: Vectors of a window, about.
WINDOW = 1024
#: The probability of missing a pair that is just similar enough.
MISS = 1e-6
MAX_BITS = 48
#: Cosines closer to the limit than this are computed again term by term.
CLOSE = 1e-9


def passes(bits: int, cosine: float, miss: float = MISS) -> int:
    """How many passes by keys of so many bits miss a pair of that cosine with probability miss."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def bits(n: int, window: int) -> int:
    """The bits of a key by which n vectors fall into windows."""
    return min(MAX_BITS, max(0, math.ceil(math.log2(n / window))))


@lru_cache(4)
def planes(dim: int, n_bits: int, n_passes: int) -> np.ndarray:
    return np.random.default_rng([11, dim, n_bits]).standard_normal((n_passes * n_bits, dim))


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no square of a component overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components, and each vector's first place and length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), at[:-1], np.diff(at)


def _keyed(members: DataFrame, cosine: float, window: int, miss: float) -> DataFrame:
    """Adds keys: of each pass the sides of its hyperplanes as a number."""

    def run(batches):
        for batch in batches:
            flat, at, size = vectors_of(batch.column("embedding"))
            kind = np.stack([size, [bits(n, window) for n in batch.column("n").to_pylist()]], 1).reshape(-1, 2)
            keys: list = [None] * batch.num_rows
            for dim, b in np.unique(kind, axis=0).tolist():
                own = np.flatnonzero((kind == (dim, b)).all(1))
                x = unit(flat[at[own][:, None] + np.arange(dim)], dim)
                t = passes(b, cosine, miss)
                side = (x @ planes(dim, b, t).T > 0).reshape(len(own), t, b)
                number = side.astype(np.int64) @ (1 << np.arange(b)[::-1]).astype(np.int64)
                for i, k in zip(own.tolist(), number):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "dim", "copies", "embedding")), pa.array(keys, pa.list_(pa.int64()))], ["node", "label", "dim", "copies", "embedding", "keys"])

    return members.mapInArrow(run, "node long, label string, dim int, copies long, embedding array<double>, keys array<long>")


def _close(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors, each sum without rounding in between."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _pairs(x: np.ndarray, wins: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """Places of pairs from left and right that are similar enough and shared no earlier window."""
    same = left is right
    for first in range(0, len(left), 256):
        own = left[first : first + 256]
        c = x[own] @ x[right].T
        i, j = np.nonzero(c >= cosine - CLOSE)
        if same:
            upper = i + first < j
            i, j = i[upper], j[upper]
        near = np.abs(c[i, j] - cosine) < CLOSE
        a, b = own[i], right[j]
        fine = ~near
        fine[near] = [_close(x[p], x[q]) >= cosine for p, q in zip(a[near].tolist(), b[near].tolist())]
        a, b = a[fine], b[fine]
        new = ~(wins[a] == wins[b]).any(1)
        yield a[new], b[new]


def _compare(cosine: float):
    def run(t: pa.Table) -> pa.Table:
        flat, at, size = vectors_of(t.column("embedding"))
        node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
        part, team = t.column("part")[0].as_py(), t.column("team")[0].as_py()
        wins = np.array(t.column("earlier").to_pylist(), np.int64).reshape(len(node), -1)
        n_links, a, b = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for dim in np.unique(size).tolist():
            there = np.flatnonzero(size == dim)
            x = np.zeros((len(node), dim))
            x[there] = unit(flat[at[there][:, None] + np.arange(dim)], dim)
            left = there[own[there] == part]
            for i, j in _pairs(x, wins, left, left if part == team else there[own[there] == team], cosine):
                np.add.at(n_links, i, copies[j])
                np.add.at(n_links, j, copies[i])
                for side, new in zip((a, b), forest(node[i], node[j])):
                    side.append(new)
        linked = np.flatnonzero(n_links)
        a, b = forest(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pa.array(np.concatenate([node[linked], a])), "b": pa.array(np.concatenate([node[linked], b])), "n": pa.array(np.concatenate([n_links[linked], np.zeros(len(a), np.int64)]))})

    return run


def links(vectors: DataFrame, cosine: float = 0.98, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (the least vec_id reachable), kept, of each
    row of vec_id, embedding, label."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("embedding"))
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    every = checkpoint(rows.withColumn("embedding", F.when(F.col("fine"), F.col("embedding"))).withColumn("row", F.monotonically_increasing_id()).withColumn("k0", F.xxhash64("label", "embedding")).withColumn("k1", F.xxhash64(F.lit(7), "embedding", "label")))
    total = every.count()
    one = every.filter("fine").groupBy("k0", "k1").agg(F.min(F.struct("row", "label", "embedding")).alias("r"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    members = checkpoint(one.select(F.col("r.row").alias("node"), "k0", "k1", "vec_id", "copies", F.col("r.label").alias("label"), F.size("r.embedding").alias("dim"), F.col("r.embedding").alias("embedding")))
    space = ["label", "dim"]
    sizes = members.groupBy(*space).agg(F.count("*").alias("n"))
    keyed = checkpoint(_keyed(frequent_join(members.select("node", *space, "copies", "embedding"), sizes, space, "n", total, "inner"), cosine, window, miss))
    # Windows: keys in order, as many of them as make up a window.
    cells = keyed.select("node", *space, F.posexplode("keys").alias("pass", "key"))
    run = [*space, "pass", "key"]
    runs = cells.groupBy(*run).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*space, "pass").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before)
    alone = F.col("n") > window
    place = F.when(alone, F.col("before")).otherwise(F.floor(F.col("before") / window))
    windows = runs.select(*run, "n", F.xxhash64(*space, "pass", alone, place).alias("win"), F.ceil(F.col("n") / (2 * window)).alias("parts"))
    dealt = frequent_join(cells, windows, run, "n", total, "inner")
    stood = dealt.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pass", "win", "parts"))).alias("stood"))
    placed = keyed.select("node", "label", "copies", "embedding").join(stood, "node")
    each = placed.select("node", "label", "copies", "embedding", "stood", F.posexplode("stood").alias("pass", "at"))
    each = each.select("node", "label", "copies", "embedding", F.transform(F.slice("stood", F.lit(1), F.col("pass")), lambda s: s["win"]).alias("earlier"), F.col("at.win").alias("win"), F.col("at.parts").alias("parts"), F.expr("pmod(xxhash64(node, at.win), at.parts)").alias("own"))
    meets = each.select("*", F.expr("inline(transform(sequence(0L, parts - 1), i -> named_struct('part', least(own, i), 'team', greatest(own, i))))")).drop("parts")
    found = checkpoint(meets.groupBy("label", "win", "part", "team").applyInArrow(_compare(cosine), "a long, b long, n long"))
    # Components, and a member's links with all their rows.
    labels = small_side(components(found.filter("a <> b").select("a", "b")))
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    of = members.select("node", "k0", "k1", "vec_id", "copies").join(labels, "node", "left").join(counts.toDF("node", "far"), "node", "left")
    of = checkpoint(of.select("k0", "k1", "vec_id", "copies", F.coalesce("component", "node").alias("component"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = of.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    known = frequent_join(of.drop("vec_id"), least, ["component"], "n", total, "inner").select("k0", "k1", "copies", "n_links", "component_id")
    linked = frequent_join(every.filter("fine").select("vec_id", "k0", "k1"), known, ["k0", "k1"], "copies", total, "inner").select("vec_id", "n_links", "component_id")
    alone = every.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
