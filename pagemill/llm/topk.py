"""Exact top-k inner products by vector-approximation files.

Vectors of integers are written to the shared folder twice: exactly, and as an approximation file of
CELL_BITS for each component (a block of rows has one cell width). A search scans the approximations only: a
matrix product over a block's cells gives bounds on every score, and of each block and query those rows go on
whose upper bound reaches the block's k-th best lower bound; over all blocks, those that reach the
k-th best of all. Then exact vectors are read in the order of their bounds: first the k rows of a query with the
best ones, whose exact scores give a sure k-th score, and then only rows whose bound reaches it. The
approximation file is scanned once for each block of QUERY_BLOCK queries (so what is broadcast, and what the driver
holds, has a fixed size; its result is written and its broadcast dropped before the next one), exact vectors are
joined to what is left of all queries, twice.

Component x counts as floor(scale * x). Vectors that are null or hold null or non-finite components
take no part; shorter vectors count as filled up with zeros. A query's own row is that of its id:
rows that repeat it are no candidates, and the row with the least vector stands for the query.
Equal scores stand in the order of vec_id; an empty table, or one without queries, has no results;
columns beside vec_id and embedding are not read.
Rows and queries with components of LIMIT or more (scaled) have no bounds: their exact scores are always read.
Only what doesn't fit a long is refused: a scaled component, or a score of the result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, ship, small_side

QUERY_BLOCK, ROW_BLOCK = 1 << 14, 8192
CELL_BITS = 7
LIMIT = 1 << 22
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Queries whose bounds are worked out together.
STEP = 256


def integers(vector: Column, scale: float) -> Column:
    """The scaled integer vector, null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=1))
    out = np.zeros((len(sizes), max(width, 1)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return _fitting(out)


def _fitting(x: np.ndarray) -> np.ndarray:
    """x, if no component stands at an end of long, where floor() puts what doesn't fit."""
    if x.max(initial=0) == MOST or x.min(initial=0) == LEAST:
        raise ValueError("a component is too large for a long")
    return x


def large(x: np.ndarray) -> np.ndarray:
    """Which rows have a component that is too large for an approximation."""
    return (x >= LIMIT).any(1) | (x <= -LIMIT).any(1)


class Approximation:
    """Cells of a block of vectors: component // width, and what they say about scores."""

    def __init__(self, cells: np.ndarray, shift: int):
        self.cells, self.width = cells, 1 << shift

    @classmethod
    def of(cls, rows: np.ndarray) -> Approximation:
        shift = max(0, int(np.abs(rows).max(initial=0)).bit_length() - CELL_BITS)
        return cls((rows >> shift).astype(np.int8), shift)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and row, the middle of the score's bounds, and of each query half their distance."""
        exact = np.float32 if np.abs(queries).sum(1).max(initial=0) * 256 < 1 << 24 else np.float64
        q = queries.astype(exact)
        half = (self.width - 1) / 2
        near = (q @ self.cells.T.astype(exact)).astype(np.float64) * self.width + half * queries.sum(1)[:, None]
        return near, half * np.abs(queries).sum(1)


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _approximated(rows: DataFrame) -> DataFrame:
    """The approximation file of rows (row, vec_id, v): a row for each block, with its rows' numbers and ids, its
    cells, and the rows that have none (bare)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                x = matrix(part.column("v"))
                bare = large(x)
                kept = Approximation.of(x[~bare])
                row, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
                order = np.concatenate([np.flatnonzero(~bare), np.flatnonzero(bare)])
                values = [kept.cells.shape[1], kept.width.bit_length() - 1, int((~bare).sum()), kept.cells.tobytes(), row[order].astype("<i8").tobytes(), ids[order].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["width", "shift", "n", "cells", "row", "ids"])

    return rows.select("row", "vec_id", "v").mapInArrow(run, "width long, shift long, n long, cells binary, row binary, ids binary")


def candidates(block: Approximation, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """Of a block and each query, the rows that may be among its k best: place of the query, row, id, lower and upper
    bound. Rows beyond the block's cells have no bounds, nor has any row for a query with large components."""
    n = len(block.cells)
    wide = max(queries.shape[1], block.cells.shape[1])
    bounded = Approximation(_wide(block.cells, wide), block.width.bit_length() - 1)
    asks_all = large(queries)
    for first in range(0, len(queries), STEP):
        some = slice(first, first + STEP)
        q = _wide(queries[some], wide)
        lower, upper = np.full((len(q), len(ids)), -np.inf), np.full((len(q), len(ids)), np.inf)
        fine = np.flatnonzero(~asks_all[some])
        if n and len(fine):
            near, half = bounded.bounds(q[fine])
            lower[np.ix_(fine, np.arange(n))], upper[np.ix_(fine, np.arange(n))] = near - half[:, None], near + half[:, None]
        own = ids[None, :] == query_ids[some][:, None]
        lower[own] = upper[own] = -np.inf
        if len(ids) > k:  # k rows reach this score at least
            upper[upper < np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k][:, None]] = -np.inf
        i, j = np.nonzero(upper > -np.inf)
        yield i + first, rows[j], ids[j], lower[i, j], upper[i, j]


def _scan(cells: DataFrame, own: list[tuple[int, list[int]]], k: int) -> tuple[DataFrame, object]:
    """query_id, row, vec_id, lower, upper of the candidates of a block of queries, and the broadcast."""
    width = max(1, max(len(v) for _, v in own))
    shared = cells.sparkSession.sparkContext.broadcast((np.array([i for i, _ in own], np.int64), np.array([v + [0] * (width - len(v)) for _, v in own], np.int64).reshape(len(own), width)))

    def run(batches):
        query_ids, queries = shared.value
        _fitting(queries)
        for batch in batches:
            for r in batch.to_pylist():
                block = Approximation(np.frombuffer(r["cells"], np.int8).reshape(r["n"], r["width"]), r["shift"])
                for found in candidates(block, np.frombuffer(r["row"], "<i8"), np.frombuffer(r["ids"], "<i8"), queries, query_ids, k):
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[found[0]]), *map(pa.array, found[1:])], ["query_id", "row", "vec_id", "lower", "upper"])

    return cells.mapInArrow(run, "query_id long, row long, vec_id long, lower double, upper double"), shared


def _scored(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, vec_id, score of pairs (query_id, row, vec_id), from the exact vectors of both."""

    def run(batches):
        for batch in batches:
            x, q = matrix(batch.column("v")), _fitting(matrix(batch.column("q")))
            wide = max(x.shape[1], q.shape[1])
            x, q = _wide(x, wide), _wide(q, wide)
            if wide * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) <= MOST:
                scores = pa.array((x * q).sum(1)).cast(pa.decimal128(38, 0))
            else:  # in Python's integers, where a long might not hold them
                scores = pa.array([Decimal(v) for v in (x.astype(object) * q.astype(object)).sum(1).tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), scores], ["query_id", "vec_id", "score"])

    met = rows.select("row", "v").join(small_side(pairs.select("query_id", "row", "vec_id")), "row").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return met.select("query_id", "vec_id", "v", "q").mapInArrow(run, "query_id long, vec_id long, score decimal(38,0)")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score from rows of vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), integers(F.col("embedding"), scale).alias("v")).filter("v is not null and vec_id is not null")
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    asked = checkpoint(rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // query_block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    cells = checkpoint(_approximated(rows))
    parts = []
    for b in range(blocks):
        own = sorted((r["vec_id"], r["v"]) for r in dealt.filter(F.col("block") == b).collect())  # some query_block rows
        if own:
            found, shared = _scan(cells, own, k)
            parts.append(checkpoint(found))
            shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    best = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "vec_id", "row"))  # noqa: E731 - a few rows of each block
    sure = every.withColumn("n", best("lower")).filter(F.col("n") <= k).groupBy("query_id").agg(F.min("lower").alias("sure"), F.count("*").alias("n"))
    left = every.join(sure, "query_id").filter((F.col("n") < k) | (F.col("upper") >= F.col("sure"))).drop("sure", "n")
    left = checkpoint(left.withColumn("place", best("upper")))
    first = checkpoint(_scored(left.filter(F.col("place") <= k), rows, asked))
    # The k-th exact score so far: no row whose bound is below it can come before.
    sure = first.groupBy("query_id").agg(F.min("score").alias("sure"), F.count("*").alias("n"))
    rest = left.filter(F.col("place") > k).join(sure, "query_id").filter((F.col("n") < k) | (F.col("upper") >= F.col("sure")))
    scores = first.unionAll(_scored(checkpoint(rest.select("query_id", "row", "vec_id")), rows, asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
