"""Pages joined with a keyword table of any size, by automata over the folded texts."""

from __future__ import annotations

import uuid
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import loose_keyword
from pagemill.sources.shared import kept

#: Keywords of one automaton, and so of one scan of the texts.
PART = 1 << 18


class Automaton:
    """Finds the keywords of a part in folded and loosened texts, as keyword_hits() does: a keyword as a substring
    of the folded text or, if it has two words or more, in its loose form of the loosened one."""

    def __init__(self, keywords: list[str]):
        self.always = [i for i, k in enumerate(keywords) if not k or (len(k.split()) > 1 and not loose_keyword(k))]
        self.folded, self.loose = (ahocorasick.Automaton() for _ in range(2))
        for i, k in enumerate(keywords):
            if k:
                self.folded.add_word(k, i)
            if len(k.split()) > 1 and (wide := loose_keyword(k)):
                # Several keywords may have one loose form.
                self.loose.add_word(wide, [*self.loose.get(wide, []), i])
        self.folded.make_automaton()
        self.loose.make_automaton()

    def found(self, folded: str, loosened: str) -> set[int]:
        out = set(self.always)
        if len(self.folded):
            out.update(i for _, i in self.folded.iter(folded))
        if len(self.loose):
            for _, own in self.loose.iter(loosened):
                out.update(own)
        return out


#: Lengths of the runs of characters that texts are asked for, and bits of each of two tables of those that they hold:
#: runs of digits alone, which prose would crowd out, and all others.
RUNS, BITS = (4, 5, 6, 7, 8, 12), 25


def _runs(data: np.ndarray, lengths: tuple[int, ...]):
    """For each length the places in the tables of all runs of that many bytes, in order of their starts."""
    digits = np.concatenate([np.zeros(1, np.int64), np.cumsum((data >= 48) & (data <= 57))])
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(lengths) + 1):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :] + np.uint64(1)
        if n in lengths:
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            other = digits[n:] - digits[:-n] < n
            yield n, (mixed >> np.uint64(64 - BITS)).astype(np.int64) + (other.astype(np.int64) << BITS)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after the other, and their bounds."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


def possible(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """The keywords (keyword) all of whose runs stand in some text; the others are in no text. Tasks mark the runs of
    their texts in tables of 2**BITS bits (4 MB); runs that share a bit let a keyword pass, never leave one out."""
    spark = pages.sparkSession

    def mark(batches):
        seen = np.zeros(2 << BITS, bool)
        for batch in batches:
            for c in ("folded", "loosened"):
                data, _ = _bytes(batch.column(c).cast(pa.string()))
                for i in range(0, len(data), 1 << 20):
                    for _, h in _runs(data[i : i + (1 << 20) + max(RUNS)].astype(np.uint64), RUNS):
                        seen[h] = True
        words = np.packbits(seen).reshape(-1, 1 << 16)
        place = np.flatnonzero(words.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([words[i].tobytes() for i in place], pa.binary())], ["place", "bits"])

    def either(key, parts):
        out = np.zeros(1 << 16, np.uint8)
        for b in parts.column("bits"):
            out |= np.frombuffer(b.as_buffer(), np.uint8)
        return pa.table({"place": [key[0].as_py()], "bits": [out.tobytes()]}, pa.schema([("place", pa.int64()), ("bits", pa.binary())]))

    seen = np.zeros((2 << BITS) // 8, np.uint8).reshape(-1, 1 << 16)
    for r in pages.select("folded", "loosened").mapInArrow(mark, "place long, bits binary").groupBy("place").applyInArrow(either, "place long, bits binary").collect():
        seen[r["place"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(seen.ravel())

    def fits(column: pa.Array) -> np.ndarray:
        """Whether all runs of a string's greatest length in RUNS are marked."""
        data, at = _bytes(column)
        size = np.diff(at)
        fine = np.ones(len(size), bool)
        of = np.digitize(size, RUNS)  # 0: shorter than all
        owner = np.repeat(np.arange(len(size)), size)
        for n, h in _runs(data.astype(np.uint64), RUNS):
            mine = owner[: len(h)]
            whole = (of[mine] > 0) & (np.array((0, *RUNS))[of[mine]] == n) & (np.arange(len(h)) + n <= at[1:][mine])
            marked = shared.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1
            fine[mine[whole & (marked == 0)]] = False
        return fine

    def run(batches):
        for batch in batches:
            words = batch.column("keyword").cast(pa.string())
            keep = fits(words)
            wide = [i for i in np.flatnonzero(~keep).tolist() if len(words[i].as_py().split()) > 1]
            if wide:
                keep[wide] = fits(pa.array([loose_keyword(words[i].as_py()) for i in wide], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("keyword").filter(pa.array(keep))], ["keyword"])

    return keywords.select("keyword").mapInArrow(run, "keyword string")


#: The automaton that this worker last made, by its part.
_MADE: dict[str, Automaton] = {}


def keyword_rows(pages: DataFrame, keywords: DataFrame, key: list[str], part: int = PART) -> DataFrame:
    """key, kind, name, hits: for each page (folded, loosened) and each (kind, name) of a keyword table (kind, name,
    keyword) how many of its rows the page holds; pairs without a hit are left out. Equal keywords are looked for
    once. Of a table of over `part` distinct keywords, those are left out first that no text can hold (possible()), by
    one more scan of the texts. The table is cut into parts of at most `part` distinct keywords; each part is an automaton that the workers
    build from a broadcast of that size, and takes one scan of the texts, whose result is written before the next
    part's broadcast, so neither tasks nor the driver hold more than one part. Null keywords are left out, null texts
    are empty ones."""
    spark = pages.sparkSession
    table = keywords.filter("keyword IS NOT NULL").groupBy("kind", "name", "keyword").agg(F.count("*").alias("n"))
    distinct = table.select("keyword").distinct()
    if table.count() > part:
        distinct = kept(possible(pages.select(F.coalesce("folded", F.lit("")).alias("folded"), F.coalesce("loosened", F.lit("")).alias("loosened")), distinct), "possible")
        table = table.join(distinct, "keyword", "left_semi")
    lists = table.groupBy("keyword").agg(F.collect_list(F.struct("kind", "name", "n")).alias("of"))  # the lists that hold a keyword
    count = distinct.count()
    parts = max(1, -(-count // part))
    lists = kept(lists.withColumn("part", F.pmod(F.xxhash64("keyword"), F.lit(parts))), "keywords")
    rows = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key)), F.coalesce("folded", F.lit("")).alias("folded"), F.coalesce("loosened", F.lit("")).alias("loosened"))
    kinds = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.select(*(f"k{i}" for i in range(len(key)))).schema)]
    out = []
    for p in range(parts):
        own = lists.filter(F.col("part") == p).select("keyword", "of").collect()  # about `part` keywords
        groups = sorted({(g["kind"] is not None, g["kind"], g["name"] is not None, g["name"]) for r in own for g in r["of"]}, key=lambda g: tuple(str(x) for x in g))
        place = {g: i for i, g in enumerate(groups)}
        of = [[(place[(g["kind"] is not None, g["kind"], g["name"] is not None, g["name"])], g["n"]) for g in r["of"]] for r in own]
        shared = spark.sparkContext.broadcast(([r["keyword"] for r in own], of, [g[1] for g in groups], [g[3] for g in groups]))

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            words, of, kind, label = shared.value
            if name not in _MADE:
                _MADE.clear()
                _MADE[name] = Automaton(words)
            automaton = _MADE[name]
            for batch in batches:
                row, group, hits = [], [], []
                for i, (folded, loosened) in enumerate(zip(batch.column("folded"), batch.column("loosened"))):
                    counts: Counter[int] = Counter()
                    for w in automaton.found(folded.as_py(), loosened.as_py()):
                        for g, n in of[w]:
                            counts[g] += n
                    row += [i] * len(counts)
                    group += counts.keys()
                    hits += counts.values()
                take = pa.array(row, pa.int64())
                at = np.array(group, np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}").take(take) for i in range(len(key))), pa.array([kind[g] for g in at], pa.string()), pa.array([label[g] for g in at], pa.string()), pa.array(hits, pa.int64())], [*(f"k{i}" for i in range(len(key))), "kind", "name", "hits"])

        found = rows.mapInArrow(run, ", ".join([*kinds, "kind string", "name string", "hits long"]))
        if parts > 1:
            found = kept(found, "hits")
            shared.destroy()
        out.append(found)
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    names = [f"k{i}" for i in range(len(key))]
    if parts > 1:
        every = every.groupBy(*names, "kind", "name").agg(F.sum("hits").alias("hits"))
    return every.select(*(F.col(n).alias(c) for n, c in zip(names, key)), "kind", "name", F.col("hits").cast("int").alias("hits"))
