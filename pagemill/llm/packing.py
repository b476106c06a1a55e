"""Best-two-fit packing of tokenized documents into sequences of fixed length.

Documents are tokenized where they lie; only a small row for each piece (id, start, length,
checksum) is shuffled. Pieces are dealt into shards of about SHARD_PIECES, whose number
grows with the input, and each shard is packed by itself: at most one sequence a shard is badly
filled. A row's place in the checkpoint decides, so rows that repeat each other are spread as well. Within
a shard pieces are counted by length, so packing takes memory and time by lengths.

A bin is filled greedily, the largest fitting piece first. If a gap is left, its smallest piece is
put back for two pieces that fit the widened gap more tightly, where there are such.

A document longer than a sequence is cut into pieces of the full length, of which the first is the
shorter rest, if any. A null text is an empty one: one piece with the end id alone. Rows that
repeat a doc_id are packed as often as they occur, and null doc_ids like any others. Pieces of equal
length are taken in the order of doc_id and piece. An empty table gives no pieces; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import tokens
from pagemill.llm.common import checkpoint, ship

#: Pieces packed together.
SHARD_PIECES = 16_384


def cut(docs: DataFrame, path: str, end_id: int, length: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    ship(docs.sparkSession)

    def run(batches):
        table = tokens.bpe(path)
        for part, ids, at in tokens.token_slices(batches, table):
            n = np.diff(at) + 1  # with the end id
            first = np.cumsum(n) - n
            flat = np.full(int(n.sum()), end_id, "<u4")
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            pieces = -(-n // length)
            of = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = n - (pieces - 1) * length  # the first piece's length
            start = np.where(piece > 0, short[of] + (piece - 1) * length, 0)
            size = np.where(piece > 0, length, short[of])
            data, begin = memoryview(flat).cast("B"), 4 * (first[of] + start)
            crc = [zlib.crc32(data[s:e]) for s, e in zip(begin.tolist(), (begin + 4 * size).tolist())]
            doc = part.column("doc_id").take(pa.array(of))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Counts of unpacked pieces by length."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.count = np.bincount(lengths, minlength=size + 1)
        self.there = self.count > 0
        # largest[g]: the largest length of at most g that is unpacked, repaired when asked
        self.largest = np.maximum.accumulate(np.where(self.there, np.arange(size + 1), 0))

    def fitting(self, gap: int) -> int:
        """The largest unpacked length of at most gap, or 0."""
        path = [gap]
        while (n := int(self.largest[path[-1]])) and not self.count[n]:
            path.append(n - 1)
        self.largest[path] = n
        return n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.there[n] = False

    def give(self, n: int) -> None:
        self.count[n] += 1
        if not self.there[n]:
            self.there[n] = True
            np.maximum(self.largest[n:], n, out=self.largest[n:])

    def pair(self, room: int, over: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum that is over `over` and at most `room`."""
        for total in range(room, over, -1):
            half = total // 2
            ok = self.there[1 : half + 1] & self.there[total - 1 : total - half - 1 : -1]
            if total % 2 == 0 and half and ok[-1] and self.count[half] < 2:
                ok[-1] = False
            found = np.flatnonzero(ok)
            if len(found):
                a = int(found[-1]) + 1
                return a, total - a
        return None


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of lengths: each piece length is in one bin, and none holds more than size."""
    left, bins = _Lengths(lengths, size), []
    while n := left.fitting(size):
        left.take(n)
        own, gap = [n], size - n
        while gap and (n := left.fitting(gap)):
            left.take(n)
            own.append(n)
            gap -= n
        if gap and len(own) > 1:
            small = own[-1]  # pieces came in falling order
            if two := left.pair(gap + small, small):
                own.pop()
                for n in two:
                    left.take(n)
                left.give(small)
                own += two
        bins.append(own)
    return bins


def pack(pieces: DataFrame, length: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length, ids_crc32."""
    spark = pieces.sparkSession
    ship(spark)
    pieces = checkpoint(pieces)  # counted and packed without tokenizing twice
    shards = max(1, -(-pieces.count() // shard_pieces))
    # Full pieces fill sequences of their own wherever they are.
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(t: pa.Table) -> pa.Table:
        n = t.column("length").to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").to_numpy(), n))
        first = np.searchsorted(n[order], np.arange(length + 2))
        next_of = first.copy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        base = int(t.column("shard")[0].as_py()) << 32
        for k, own in enumerate(best_two_fit(n, length)):
            at = 0
            for x in own:
                row = order[next_of[x]]
                next_of[x] += 1
                sequence[row], offset[row] = base + k, at
                at += x
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = 1024, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    return pack(cut(docs, path, end_id, length), length, shard_pieces)
