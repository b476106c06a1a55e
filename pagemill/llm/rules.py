"""Quality rules with thresholds that adapt to each language and source.

Measures of each text are computed in one vectorised pass. Their distributions are gathered in
mergeable quantile sketches: counts by buckets of integers with SKETCH_BITS significant bits, so a
quantile is off by at most 1/16 of its value, and merging is adding counts: the result doesn't
depend on the order of rows, tasks or retries. Sketches of (lang, source) are merged into those of
lang and of everything; a group of under MIN_ROWS rows takes the thresholds of the next wider one.
A measure fails beyond q3 + FENCE * (q3 - q1) + margin (word length also below q1 likewise).
Thresholds are joined to the rows by lang and source: as a broadcast up to MAX_BROADCAST_GROUPS groups,
beyond that with frequent groups apart. Where texts are kept, a second pass measures them again, so
that no text is written or shuffled; else the measures are written once and used twice.

n_* and word_chars are defined in measure(). Null texts are empty: they have no words and fail.
Null langs and sources are groups of their own. Repeated rows count as often as they occur; an empty
table has no verdicts; columns are carried under names of their own, so none can clash.
Equality of words and lines is that of their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, frequent_join, mix, quoted, ship, slices, span_hashes, text_arrays, word_spans

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SKETCH_BITS = 4
MIN_ROWS, FENCE = 200, 3
MAX_BROADCAST_GROUPS = 1 << 14
#: Measure (an integer per thousand): its expression, the least distance of the upper threshold
#: from q3, and that of the lower one from q1 if there is one.
MEASURES = {
    "symbols": ("1000 * n_symbols DIV greatest(n_words, 1)", 150, None),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", 300, None),
    "repeats": ("1000 * n_repeat_words DIV greatest(n_words, 1)", 250, None),
    "word_length": ("1000 * word_chars DIV greatest(n_words, 1)", 2000, 1500),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _repeated(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, whether its text holds it twice or more, and whether it isn't the first."""
    order = np.argsort(own := mix(key ^ mix(text.astype(np.uint64))), kind="stable")
    same = np.zeros(len(own) + 1, bool)
    same[1:-1] = own[order][1:] == own[order][:-1]
    again, later = np.zeros(len(own), bool), np.zeros(len(own), bool)
    again[order], later[order] = same[1:] | same[:-1], same[:-1]
    return again, later


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words: runs without ASCII white space; word_chars: their code points; n_symbols: SYMBOLS;
    n_lines: lines with a word, n_dup_lines: those equal to an earlier one; n_repeat_words: words in
    3-word windows that occur twice or more in the text."""
    n = len(offsets) - 1
    starts, lens, text = word_spans(buf, offsets)
    out = {"n_words": np.bincount(text, minlength=n)}
    lead = (buf & 0xC0) != 0x80
    space = _per_text((buf == 0x20) | ((buf >= 9) & (buf <= 13)), offsets)
    out["word_chars"] = _per_text(lead, offsets) - space
    out["n_symbols"] = _per_text(_SYMBOL[buf], offsets)
    ls, ll, lt = word_spans(buf, offsets, buf != 0x0A)
    has = np.searchsorted(starts, ls + ll) > np.searchsorted(starts, ls)
    ls, ll, lt = ls[has], ll[has], lt[has]
    out["n_lines"] = np.bincount(lt, minlength=n)
    out["n_dup_lines"] = np.bincount(lt[_repeated(span_hashes(buf, ls, ll), lt)[1]], minlength=n)
    h = span_hashes(buf, starts, lens)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        whole = text[2:] == text[:-2]
        w = mix(h[:-2]) + mix(h[1:-1] * np.uint64(3)) * np.uint64(5) + mix(h[2:] * np.uint64(7)) * np.uint64(9)
        again = np.zeros(len(w), bool)
        again[whole] = _repeated(w[whole], text[2:][whole])[0]
        for k in range(3):
            covered[k : k + len(again)] |= again
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    return out


def with_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and the counts of measure()."""
    ship(docs.sparkSession)
    kept = docs.select(*map(quoted, keep)).schema
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for part in slices(batches):
            got = measure(*text_arrays(part.column("text")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(got[c], pa.int64()) for c in _COUNTS)], [*names, *_COUNTS])

    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept)), *(f"{c} long" for c in _COUNTS)])
    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(f"doc.{c}") for c, n in zip(keep, names)), *_COUNTS)


def bucket(v: Column) -> Column:
    """The sketch's bucket of an integer of 0 or more."""
    low = F.greatest(F.length(F.bin(v)) - 1 - SKETCH_BITS, F.lit(0))
    return (low * (1 << SKETCH_BITS) + F.call_function("shiftright", v, low)).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least integer of a bucket."""
    size = 1 << SKETCH_BITS
    low = F.greatest((b / size).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", b - low * size, low).cast("long")


def thresholds(measured: DataFrame) -> DataFrame:
    """l and s (lang and source of a group), its rows, and limits: lo and hi for each measure."""
    names = list(MEASURES)
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), bucket(F.expr(MEASURES[k][0])).alias("b")) for i, k in enumerate(names))))
    base = measured.select(F.col("`doc.lang`").alias("lang"), F.col("`doc.source`").alias("source"), pairs.alias("p")).groupBy("lang", "source", "p.m", "p.b").count()
    # base has a row for each group, measure and bucket; what follows merges these counts.
    levels = base.select("lang", "source", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"), "m", "b", "count")
    key_lang, key_source = F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source"))
    merged = levels.groupBy("level", key_lang.alias("l"), key_source.alias("s"), "m", "b").agg(F.sum("count").alias("n"))
    fences = merged.groupBy("level", "l", "s", "m").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("h"))  # at most some 500 buckets each

    def quantile(percent: int) -> Column:
        passed = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("c"), F.lit(-1).cast("long").alias("b")), lambda a, x: F.when((a["b"] < 0) & ((a["c"] + x["n"]) * 100 >= F.col("rows") * percent), F.struct((a["c"] + x["n"]).alias("c"), x["b"].alias("b"))).otherwise(F.struct((a["c"] + x["n"]).alias("c"), a["b"].alias("b"))))
        return bucket_floor(passed["b"])

    fences = fences.withColumn("q1", quantile(25)).withColumn("q3", quantile(75))
    up = F.create_map(*(x for i, k in enumerate(names) for x in (F.lit(i), F.lit(MEASURES[k][1]).cast("long"))))
    down = F.create_map(*(x for i, k in enumerate(names) for x in (F.lit(i), F.lit(1 << 40 if MEASURES[k][2] is None else MEASURES[k][2]).cast("long"))))
    spread = F.lit(FENCE) * (F.col("q3") - F.col("q1"))
    wide = fences.select("level", "l", "s", "rows", "m", (F.col("q3") + spread + up[F.col("m")]).alias("hi"), (F.col("q1") - spread - down[F.col("m")]).alias("lo"))
    wide = wide.groupBy("level", "l", "s").agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("m") == i, F.col(c))).alias(f"{c}_{k}") for i, k in enumerate(names) for c in ("lo", "hi")))
    marks = F.struct("rows", *(f"{c}_{k}" for k in names for c in ("lo", "hi")))
    wide = checkpoint(wide)  # a row for each group
    every = wide.filter("level = 2").select(marks.alias("t")).first()
    if every is None:
        return wide.select("l", "s", F.lit(0).cast("long").alias("rows"), marks.alias("limits"))
    every = F.struct(*(F.lit(v).cast("long").alias(k) for k, v in every["t"].asDict().items()))
    by = [wide.filter(F.col("level") == i).select("l", *["s"] * (i == 0), marks.alias(f"t{i}")) for i in range(2)]
    out = by[0].join(by[1].withColumnRenamed("l", "l1"), F.col("l").eqNullSafe(F.col("l1")))
    chosen = F.when(F.col("t0.rows") >= MIN_ROWS, F.col("t0")).when(F.col("t1.rows") >= MIN_ROWS, F.col("t1")).otherwise(every)
    return out.select("l", "s", F.col("t0.rows").alias("rows"), chosen.alias("limits"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, lang and source (each as `doc.<name>`), the counts, base_failed and kept of
    each row."""
    texts, keep = "text" in keep, list(dict.fromkeys([*keep, "lang", "source"]))
    rows = with_measures(docs, keep)
    if not texts:
        rows = checkpoint(rows)
    limits = checkpoint(thresholds(with_measures(docs, ["lang", "source"]) if texts else rows))
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    # Keys without nulls: whether there is a value, and the value.
    key = lambda c: F.struct(F.isnull(c).alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("name"))
    limits = limits.select(key(F.col("l")).alias("_l"), key(F.col("s")).alias("_s"), F.col("rows").alias("_rows"), "limits")
    rows = rows.withColumn("_l", key(F.col("`doc.lang`"))).withColumn("_s", key(F.col("`doc.source`")))
    if limits.count() <= MAX_BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(limits), ["_l", "_s"], "left")
    else:
        rows = frequent_join(rows, limits, ["_l", "_s"], "_rows", limits.agg(F.sum("_rows")).first()[0])
    inside = F.lit(True)
    for k, (value, _, _) in MEASURES.items():
        inside &= F.expr(value).between(F.col(f"limits.lo_{k}"), F.col(f"limits.hi_{k}"))
    rows = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return rows.select(*(quoted(f"doc.{c}") for c in keep), *_COUNTS, "base_failed", "kept")
