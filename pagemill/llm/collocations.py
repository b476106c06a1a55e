r"""Phrase collocations, counted by pivot partitioning.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\x0A-\x0D]` and the pieces into words
`[^\x20\x09]+`. A phrase of 2 to 3 words is owned by its pivot, the rarest of its words: where it stands,
the leftmost of the least words in one order of all words. The order is that of SLOTS counters of a fixed
size, to which words are dealt by hash (a counter is never less than the count of a word in it), rounded to
quarters of octaves; equal ones stand by the words' numbers. So every task knows the order, whatever the
size of the vocabulary, and words of a counter under MIN_COUNT, which no candidate holds, are left out.

1. Words are counted. A word's number is a 64-bit hash; that no two words of a language share one is
   checked, and numbers are dealt anew by another hash if any do.
2. For each word as a pivot its text is rewritten to a fragment: up to two words before it, as far as they
   are above it in the order, and up to two words after it that aren't below it. Equal fragments of a task
   become one with a count. Fragments go to their pivot's partition, and there all phrases that hold the pivot are
   counted: each phrase at each of its places lies in one fragment just once. Pivots with over a
   thousandth of all words are dealt to several partitions, whose counts are added.
3. Phrases with MIN_COUNT and more are scored with the counts of their parts, which are words and phrases
   with at least as many.

A null text is an empty one; a null lang is `und`. Long texts and words are read whole, repeated rows count
each, an empty table has no phrases; columns beside lang and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, mix, rows_of, ship, slices, span_hashes, span_hashes_2, text_arrays, word_spans

MIN_COUNT, TOP, INSIDE_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: Counters of the words' order.
SLOT_BITS = 22
#: Distinct words or fragments that a task holds before it hands them on.
HELD = 1 << 19
#: Rows of a batch that a task hands on.
GIVEN = 1 << 16
#: A pivot is dealt to one partition more for each 1/SHARE of all words.
SHARE = 1000
#: Rows of the word table up to which it is broadcast.
MAX_WORDS = 1 << 18
#: Candidates of a language that are ranked together first.
RANKED = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_CUT
_WORD[[0x20, 0x09]] = False


class Words:
    """The words of a batch: their bytes, numbers, counters, text, and whether a word goes on with its piece."""

    def __init__(self, part: pa.RecordBatch, salt: int):
        buf, offsets = text_arrays(part.column("text"))
        self.buf = _LOWER[buf]
        self.starts, self.lens, text = word_spans(self.buf, offsets, _WORD[self.buf])
        cuts = np.cumsum(_CUT[self.buf], dtype=np.int32)[self.starts]
        self.goes_on = np.zeros(len(text), bool)
        self.goes_on[1:] = (text[1:] == text[:-1]) & (cuts[1:] == cuts[:-1])
        self.id = number(self.buf, self.starts, self.lens, salt)
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[text]
        names, at = text_arrays(pa.array(["-" + x for x in self.langs.to_pylist()]))
        own = span_hashes(names, at[:-1], np.diff(at))
        self.slot = (mix(self.id ^ own[self.lang]) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def number(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers of words, none of them 0; each salt gives others."""
    if salt:
        a, b = span_hashes_2(buf, starts, lens)
        out = mix(a ^ mix(b + np.uint64(salt)))
    else:
        out = span_hashes(buf, starts, lens)
    out[out == 0] = 1
    return out


def strings(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> pa.Array:
    at = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    bytes_ = buf[np.arange(at[-1]) + np.repeat(starts - at[:-1], lens)]
    return pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(at), pa.py_buffer(bytes_)])


def summed(columns: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows and their summed counts. Rows are sorted by a hash and compared with the one
    before; what shares a hash by chance stays apart."""
    h = np.zeros(len(count), np.uint64)
    for c in columns:
        h = mix(h ^ c.view(np.uint64)) + np.uint64(1)
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(count[order], at) if len(at) else count[:0]


def _words(docs: DataFrame, salt: int, most: int) -> DataFrame:
    """lang, id, slot, word, n: a row for each word, with its number of occurrences."""
    schema = "lang string, id long, slot int, word string, n long"

    def run(batches):
        held: list = []
        for part in slices(batches):
            w = Words(part, salt)
            at, n = summed([w.lang.astype(np.int64), w.id.view(np.int64)], np.ones(len(w.id), np.int64))
            held.append(pa.table([w.langs.take(pa.array(w.lang[at])), pa.array(w.id[at].view(np.int64)), pa.array(w.slot[at]), strings(w.buf, w.starts[at], w.lens[at]).cast(pa.string()), pa.array(n)], ["lang", "id", "slot", "word", "n"]))
            if sum(t.num_rows for t in held) >= most:
                yield from _merged(held).to_batches(GIVEN)
                held = []
        if held:
            yield from _merged(held).to_batches(GIVEN)

    rows = docs.mapInArrow(run, schema)
    return rows.groupBy("lang", "id").agg(F.first("slot").alias("slot"), F.min("word").alias("word"), F.max("word").alias("last"), F.sum("n").alias("n"))


def _merged(held: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(held).group_by(["lang", "id", "slot", "word"], use_threads=False).aggregate([("n", "sum")])
    return t.rename_columns({"n_sum": "n"}).select(["lang", "id", "slot", "word", "n"])


def words_of(docs: DataFrame, held: int = HELD) -> tuple[DataFrame, int]:
    """A checkpoint of lang, id, slot, word, n, and the salt by which ids differ where words do."""
    salt = 0
    while True:
        words = checkpoint(_words(docs, salt, held))
        if words.filter("word <> last").isEmpty():
            return words.drop("last"), salt
        salt += 1


def levels(words: DataFrame, least: int) -> np.ndarray:
    """The order's level of each counter: 0 for a sum under `least`, else by quarters of octaves."""
    block = 16  # bits of a counter's place in its row

    def run(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << block, np.uint8)
        n = t.column("n").to_numpy()
        out[t.column("slot").to_numpy() & ((1 << block) - 1)] = np.where(n < least, 0, 1 + np.floor(4 * np.log2(np.maximum(n, 1))).clip(0, 254))
        return pa.table({"at": t.column("at")[:1], "levels": pa.array([out.tobytes()], pa.binary())})

    slots = words.groupBy("slot").agg(F.sum("n").alias("n")).withColumn("at", F.shiftright("slot", block))
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in slots.groupBy("at").applyInArrow(run, "at int, levels binary").collect():  # 2^SLOT_BITS bytes
        out[r["at"] << block : (r["at"] + 1) << block] = np.frombuffer(r["levels"], np.uint8)
    return out


FRAGMENT = ["pivot", "l2", "l1", "r1", "r2"]


def fragments(docs: DataFrame, order: np.ndarray, total: int, salt: int, most: int = HELD, share: int = SHARE) -> DataFrame:
    """lang, pivot, l2, l1, r1, r2 (numbers of words, 0 where none), n, salts and salt: fragments with
    how often a task found them."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    salts = np.array([1 + share * min(int(2 ** ((k - 1) / 4)), total) // max(total, 1) if k else 1 for k in range(256)], np.int64)
    schema = "lang string, " + ", ".join(f"{c} long" for c in FRAGMENT) + ", n long, salts long, salt long"

    def cut(w: Words) -> list[np.ndarray]:
        level = shared.value[w.slot]
        rank = level.astype(np.uint64) << np.uint64(56) | w.id >> np.uint64(8)
        rank[level == 0] = 0
        n = len(rank)

        def beside(k: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            if k < 0:
                out[-k:] = rank[:k]
            else:
                out[:-k] = rank[k:]
            return out

        on1, on2 = np.zeros(n, bool), np.zeros(n, bool)  # whether the next and the one after are of the piece
        on1[:-1] = w.goes_on[1:]
        on2[:-1] = on1[:-1] & on1[1:]
        back2 = w.goes_on.copy()
        back2[1:] &= w.goes_on[:-1]
        back2[:1] = False
        l1 = w.goes_on & (beside(-1) > rank) if n > 1 else np.zeros(n, bool)
        l2 = l1 & back2 & (beside(-2) > rank) if n > 2 else np.zeros(n, bool)
        r1 = on1 & (beside(1) >= rank) if n > 1 else np.zeros(n, bool)
        r2 = r1 & on2 & (beside(2) >= rank) if n > 2 else np.zeros(n, bool)
        at = np.flatnonzero((l1 | r1) & (level > 0))
        ids = w.id.view(np.int64)
        take = lambda there, k: np.where(there[at], ids[(at + k) % n], 0)
        return [ids[at], take(l2, -2), take(l1, -1), take(r1, 1), take(r2, 2), salts[level[at]], w.lang[at].astype(np.int64)]

    def given(held: list[list[np.ndarray]], langs: list[str]):
        *columns, many, lang = (np.concatenate(c) for c in zip(*held))
        held.clear()
        at, n = summed([*columns, lang], np.ones(len(lang), np.int64))
        at_pivot = np.lexsort((columns[0][at], lang[at]))
        at, n = at[at_pivot], n[at_pivot]
        for first in range(0, len(at), GIVEN):
            some = at[first : first + GIVEN]
            own = [c[some] for c in columns]
            h = np.zeros(len(some), np.uint64)
            for c in own:
                h = mix(h ^ c.view(np.uint64)) + np.uint64(1)
            deal = (h >> np.uint64(1)).astype(np.int64) % many[some]
            yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(lang[some])), *map(pa.array, own), pa.array(n[first : first + GIVEN]), pa.array(many[some]), pa.array(deal)], ["lang", *FRAGMENT, "n", "salts", "salt"])

    def run(batches):
        held, langs, size = [], {}, 0
        for part in slices(batches):
            w = Words(part, salt)
            if not len(w.id):
                continue
            columns = cut(w)
            name = np.array([langs.setdefault(x, len(langs)) for x in w.langs.to_pylist()], np.int64)
            columns[-1] = name[columns[-1]]
            held.append(columns)
            size += len(columns[0])
            if size >= most:
                yield from given(held, list(langs))
                size = 0
        if size:
            yield from given(held, list(langs))

    return docs.mapInArrow(run, schema)


_GRAMS = """inline(array(
    named_struct('w1', l1, 'w2', pivot, 'w3', 0L),
    named_struct('w1', pivot, 'w2', r1, 'w3', 0L),
    named_struct('w1', l2, 'w2', l1, 'w3', pivot),
    named_struct('w1', IF(r1 = 0, 0L, l1), 'w2', pivot, 'w3', r1),
    named_struct('w1', IF(r2 = 0, 0L, pivot), 'w2', r1, 'w3', r2)))"""


def phrases(parts: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3 (0 in phrases of two words), a: phrases with `least` occurrences or more."""
    dealt = parts.repartition("lang", "pivot", "salt")
    grams = dealt.select("lang", "pivot", "salt", "salts", "n", F.expr(_GRAMS)).filter("w1 <> 0 AND w2 <> 0")
    # Dealt by its pivot already: no exchange.
    own = grams.groupBy("lang", "pivot", "salt", "w1", "w2", "w3").agg(F.sum("n").alias("a"), F.first("salts").alias("salts"))
    # All of a phrase stands in one row, but for those of dealt pivots.
    whole = own.filter((F.col("salts") > 1) | (F.col("a") >= least)).groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a"))
    return whole.filter(F.col("a") >= least)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) by whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def scored(found: DataFrame, words: DataFrame, inside_percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase that no longer one mostly holds. found: a checkpoint of phrases;
    words: lang, id, word, n of all words that phrases hold."""
    few = rows_of(words) <= MAX_WORDS
    of = lambda k: (lambda t: F.broadcast(t) if few else t)(words.select("lang", F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}")))
    two, three = found.filter("w3 = 0").drop("w3"), found.filter("w3 <> 0")
    # What longer phrases have of each phrase of two words.
    ends = three.select("lang", "a", F.expr("inline(array(named_struct('w1', w1, 'w2', w2), named_struct('w1', w2, 'w2', w3)))"))
    longer = ends.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two_left = two.join(longer, ["lang", "w1", "w2"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * inside_percent, F.lit(True)))
    pairs = two_left.join(of(1), ["lang", "w1"]).join(of(2), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), score(F.col("a"), F.col("n1"), F.col("n2")).alias("score"))
    first = two.select("lang", "w1", "w2", F.col("a").alias("first"))
    rest = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("rest"))
    all3 = three.join(first, ["lang", "w1", "w2"]).join(rest, ["lang", "w2", "w3"]).join(of(1), ["lang", "w1"]).join(of(2), ["lang", "w2"]).join(of(3), ["lang", "w3"])
    cut = lambda k, left, right: F.struct(score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    best = F.least(cut(1, "n1", "rest"), cut(2, "first", "n3"))
    triples = all3.withColumn("best", best).select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "best.l", "best.r", "best.score")
    return pairs.unionByName(triples)


def mine(docs: DataFrame, least: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP, held: int = HELD, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words, salt = words_of(rows, held)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    found = checkpoint(phrases(fragments(rows, levels(words, least), total, salt, held, share), least))
    out = checkpoint(scored(found, words.filter(F.col("n") >= least).select("lang", "id", "word", "n"), inside_percent))
    # The best of each deal, then of all: no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    deals = max(1, rows_of(out) // RANKED)
    own = out.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(deals)))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    best = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
