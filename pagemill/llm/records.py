"""Length-delimited binary records of token ids, with a separate offset index.

A record is: payload length (8 bytes), masked crc32 of those 8 bytes (4), payload, masked crc32 of
the payload (4), a line feed; numbers are little-endian. A payload is: the document id (8 bytes,
signed), the bytes of an id (1; 0x80 is set if the document id is null), the ids. A masked checksum
is the crc32 turned right by 15 bits plus MASK, so that a checksum of data that hold checksums
stays sound.

Texts are dealt by range of doc_id to files of about FILE_BYTES of text and tokenized there (two-byte ids
take about as much room as the text, so shuffling them would save nothing and tokenizing first would keep
them twice). Files in the order of their numbers hold documents in ascending order; rows that
repeat a doc_id stand side by side in the order of a hash of their texts and then of their places in the
input, so a doc_id with very many rows, even equal ones, is split between files. (The input has to give its
rows in the same order when a task reads it again, as tables and checkpoints do.) Spark's own writer and its committer write the files to any store, and a
task that runs again leaves no second copy. The index is written from the files, every record of which
is checked on the way: file number, offset, length, doc_id, n_tokens. read() reads all files in order;
read_at() reads the records of index rows, in any order, through their offsets alone.

A null text is an empty one: the end id alone. Null doc_ids come first, repeated rows are records of
their own, an empty table gives one file without records, columns beside doc_id and text are not read.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import tokens
from pagemill.llm.common import shared_dir, ship

#: Bytes of text in a file, about.
FILE_BYTES = 16 << 20
#: Index rows up to which read_at() broadcasts them.
MAX_BROADCAST_ROWS = 1 << 18
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, width | (0x80 if doc_id is None else 0)) + ids.astype(f"<u{width}").tobytes()
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", masked(n)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: document id, ids, the next record's offset. Raises ValueError on damage."""
    n, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"damaged record at {at}")
    doc_id, kind = struct.unpack_from("<qB", payload)
    return None if kind & 0x80 else doc_id, np.frombuffer(payload[9:], f"<u{kind & 0x7F}"), at + 12 + n + 5


def write(docs: DataFrame, path: str, end_id: int, out: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes files of records to out/data and the offset index to out/index."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        table = tokens.bpe(path)
        for part, ids, at in tokens.token_slices(batches, table):
            width = 2 if int(ids.max(initial=end_id)) < 1 << 16 else 4
            end = np.array([end_id], np.uint32)
            rows = [frame(d, np.concatenate([ids[a:b], end]), width) for d, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))
    order = ["doc_id", "tie", "place"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = dealt.select("doc_id", "text").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.mode("overwrite").text(f"{out}/data")

    def scan(batches):
        for file, data in _contents(batches):
            at, found = 0, []
            while at < len(data):
                doc_id, ids, after = unframe(data, at)
                found.append((file, at, after - at, doc_id, len(ids)))
                at = after
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], INDEX)

    _files(spark, out).mapInArrow(scan, "file int, offset long, length long, doc_id long, n_tokens long").write.mode("overwrite").parquet(f"{out}/index")


INDEX = ["file", "offset", "length", "doc_id", "n_tokens"]


def number(name: str) -> int:
    return int(re.match(r"part-(\d+)", posixpath.basename(name))[1])


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/data").select("path", "content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, memoryview]]:
    for batch in batches:
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            yield number(name), memoryview(data.as_buffer())


def starts(spark: SparkSession, out: str) -> DataFrame:
    """file, start: the ids of all files before it. Sums run in blocks of files, then over blocks."""
    sums = spark.read.parquet(f"{out}/index").groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr("file DIV 1024"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n")).withColumn("at", F.col("block")).withColumn("first", before(F.lit(0))).select("block", "first")
    own = sums.withColumn("at", F.col("file")).withColumn("inner", before("block"))
    return own.join(blocks, "block").select("file", (F.col("first") + F.col("inner")).alias("start"))


def read(spark: SparkSession, out: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, checked against its checksums; with
    keep_ids also ids."""
    ship(spark)
    schema = "file int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        for file, data in _contents(batches):
            at, start, found, texts = 0, 0, [], []
            while at < len(data):
                doc_id, ids, at = unframe(data, at)
                found.append((doc_id, start, len(ids), tokens.crc32(ids)))
                start += len(ids)
                if keep_ids:
                    texts.append(ids.astype(np.int32))
            if found:
                columns = [pa.array([file] * len(found), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*found))] + [pa.array(texts, pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    rows = _files(spark, out).mapInArrow(run, schema).join(starts(spark, out), "file")
    return rows.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def read_at(spark: SparkSession, out: str, asked: DataFrame) -> DataFrame:
    """place, doc_id, ids of the records that rows of asked (place, file, offset) point to: a shuffled
    read, whose order is that of place. Each file is opened once and read at its offsets only."""
    ship(spark)
    lists = asked.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", F.col("place").cast("long").alias("place")))).alias("asked"))  # records of one file
    few = asked.count() <= MAX_BROADCAST_ROWS

    def run(batches):
        for batch in batches:
            for data, own in zip(batch.column("content"), batch.column("asked").to_pylist()):
                data = memoryview(data.as_buffer())
                got = [(x["place"], *unframe(data, x["offset"])[:2]) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].astype(np.int32) for g in got], pa.list_(pa.int32()))], ["place", "doc_id", "ids"])

    files = _files(spark, out).withColumn("file", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int"))
    return files.join(F.broadcast(lists) if few else lists, "file").select("content", "asked").mapInArrow(run, "place long, doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Writes the records to a new folder of the shared store and reads them back. The folder stays, for
    the result is read from it when it is used."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    write(docs, path, end_id, out)
    return read(spark, out, keep_ids)
