"""Shared helpers: tables, checkpoints, code shipping and byte-level views of text batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; one longer text is a step of its own.
SLICE_BYTES = 1 << 20

#: ASCII white space: \x20 and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_pagemill_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp()) / "pagemill_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((top / "pagemill").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(out))
    sc._pagemill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary
    folder of this machine, if driver and executors are one process; else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark can write to."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def tidy(spark: SparkSession) -> None:
    """Lets go of what the driver holds but nothing refers to: Spark's cleaner drops broadcasts and shuffle
    files once their handles are collected, which may else take long."""
    gc.collect()
    spark._jvm.System.gc()
    release()


def discard(*frames: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing will read again."""
    for df in frames:
        found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if found.isDefined():
            remove(df.sparkSession, found.get())


#: Rows of a few numbers up to which a side of a join is broadcast.
MAX_BROADCAST_ROWS = 1 << 20


def rows_of(df: DataFrame) -> int:
    """The rows of a checkpoint, counted by few tasks."""
    return df.coalesce(max(1, df.rdd.getNumPartitions() // 32)).count()


def small_side(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows, to be joined to: broadcast if it has at most MAX_BROADCAST_ROWS."""
    n = rows_of(df)
    return F.broadcast(df.coalesce(max(1, n >> 16))) if n <= MAX_BROADCAST_ROWS else df


#: A key counts as frequent if it holds over one row in so many.
FREQUENT = 1000


def frequent_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """rows joined to keyed, which has one row for each key and in n how many rows have it. Keys with
    over total / FREQUENT rows, of which there are fewer than FREQUENT, are broadcast, so no task
    gets a frequent key's rows; the others are shuffled."""
    often = F.col(n) > max(total // FREQUENT, 1)
    value = [c for c in keyed.columns if c not in on]
    hot = F.broadcast(keyed.filter(often).withColumn("_often", F.lit(True)))
    met = rows.join(hot.select(*on, "_often", *value), on, "left")
    columns = [quoted(c) for c in (*on, *(c for c in rows.columns if c not in on))]
    cold = met.filter("_often is null").select(*columns).join(keyed.filter(~often), on, how)
    return met.filter("_often").select(*columns, *value).unionByName(cold.select(*columns, *value))


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and each text's offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n, at = len(texts), texts.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, data = texts.buffers()
    offsets = np.frombuffer(o, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Functions that empty the caches of a Python worker, which serves tasks of many kinds.
_CACHES: list[Callable[[], None]] = []


def cached(f):
    """f with its results kept in the Python worker, until a task comes that has no use for them."""
    kept = lru_cache(4)(f)
    _CACHES.append(kept.cache_clear)
    return kept


def release() -> None:
    """Gives memory that isn't used back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", keep_caches: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about SLICE_BYTES of text each."""
    if not keep_caches:
        for clear in _CACHES:
            clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_arrays(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans of up to so many bytes are hashed by chained 8-byte reads, longer ones by blocks.
_CHAIN, _BLOCK = 64, 4096
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = mix(np.arange(1, 3, dtype=np.uint64))
_POWERS = mix(np.arange(1, _BLOCK + 1, dtype=np.uint64)) | np.uint64(1)


def _long_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block of _BLOCK bytes is a sum of bytes times odd numbers; these sums are mixed with the
    block's number, for each seed on its own, before they are added."""
    blocks = -(-lens // _BLOCK)
    of = np.repeat(np.arange(len(lens)), blocks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[of] + number * _BLOCK
    size = np.minimum(lens[of] - number * _BLOCK, _BLOCK)
    firsts = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(firsts, size)
    part = buf[at + np.repeat(begin, size)].astype(np.uint64) + np.uint64(1)
    odd = _POWERS[at]
    out = []
    for seed, turn in zip(_SEEDS, (0, 17)):
        own = np.add.reduceat(part * (odd if not turn else mix(odd) | np.uint64(1)), firsts)
        own = mix(own ^ mix(seed + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out.append(mix(np.add.reduceat(own, np.cumsum(blocks) - blocks) ^ mix(lens.astype(np.uint64) + seed)))
    return out[0], out[1]


def span_hashes_2(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seeds: int = 2) -> list[np.ndarray]:
    """64-bit hashes of each byte span buf[start : start + len] by one or two seeds that share nothing
    but the reading. A hash depends on the span's bytes alone. Spans hold a byte at least."""
    n = len(starts)
    if not n:
        return [np.zeros(0, np.uint64)] * seeds
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    at8 = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    width = lens.astype(np.uint64)
    out = [mix(width + s) for s in _SEEDS[:seeds]]
    long = lens > _CHAIN
    left = None if not long.any() else np.flatnonzero(~long)
    done = 0
    while left is None or len(left):
        s, rest = (starts, lens) if left is None else (starts[left], lens[left])
        read = at8[s + done] & _MASKS[np.minimum(rest - done, 8)]
        for k, h in enumerate(out):
            if left is None:
                out[k] = mix(h ^ read)
            else:
                h[left] = mix(h[left] ^ read)
        done += 8
        left = np.flatnonzero(lens > done) if left is None else left[rest > done]
    if long.any():
        for h, own in zip(out, _long_hashes(buf, starts[long], lens[long])):
            h[long] = own
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return span_hashes_2(buf, starts, lens, 1)[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and text numbers of words: runs of bytes for which `inside` holds (default:
    no ASCII white space)."""
    word = ~IS_SPACE[buf] if inside is None else inside
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1
