"""Accent-insensitive text functions as Column expressions. A null text counts as an empty one."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Characters that lower case leaves as they are, and the one ASCII character that each decomposes to."""
    pairs = {}
    for code in range(0x00A0, 0x3000):  # no character beyond has one
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c.casefold()) if x.isascii())
        if c == c.lower() and len(base) == 1:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _fold_table()
#: Presentation ligatures, which PDF text often has.
LIGATURES = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold(text: Column) -> Column:
    """Lower case, accents off, other characters beyond ASCII dropped, white space collapsed. Only texts that
    hold a character beyond ASCII take the steps for these."""
    c = F.lower(F.coalesce(text, F.lit("")))
    wide = c
    for a, b in LIGATURES.items():
        wide = F.replace(wide, F.lit(a), F.lit(b))
    wide = F.regexp_replace(F.translate(wide, _FROM, _TO), r"[^\x00-\x7F]", "")
    narrow = F.when(text.rlike(r"[^\x00-\x7F]"), wide).otherwise(c)
    return F.trim(F.regexp_replace(narrow, r"[\x09-\x0d\x1c-\x20]+", " "))


def loosen(folded: Column) -> Column:
    """Of a folded text: runs of other characters than letters and digits become one space."""
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def with_folded(rows: DataFrame, text: str = "text", folded: str = "folded", loosened: str = "loosened") -> DataFrame:
    """Adds the folded text and the loosened one. They are columns of their own, so that whatever tests
    them many times doesn't fold again: every operator on folded text takes these columns."""
    return rows.withColumn(folded, fold(F.col(text))).withColumn(loosened, loosen(F.col(folded)))


def slugify(text: Column) -> Column:
    slug = F.btrim(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("document"))


def loose(text: Column) -> Column:
    return loosen(fold(text))


def tokens(folded: Column) -> Column:
    """Runs of letters and digits of a folded text."""
    return F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1)


def count_markers(folded: Column, markers: list[str], window: int | None = None) -> Column:
    """How many markers the first `window` characters hold."""
    head = folded if window is None else F.substring(folded, 1, window)
    total = F.lit(0)
    for m in markers:
        total = total + F.contains(head, F.lit(m)).cast("int")
    return total


def loose_keyword(keyword: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in keyword).split())


def keyword_hits(folded: Column, loosened: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds, in their order, duplicates kept: as a substring of the folded
    text or, for those of two words or more, of the loosened one. Keywords are folded already."""
    tests = []
    for k in keywords:
        test = F.contains(folded, F.lit(k))
        if len(k.split()) > 1:
            test = test | F.contains(loosened, F.lit(loose_keyword(k)))
        tests.append(F.when(test, F.lit(k)))
    return F.filter(F.array(*tests).cast("array<string>"), lambda x: x.isNotNull())


def literal(text: str) -> str:
    """A string in Spark's SQL. Where an expression has hundreds of parts, SQL is parsed at once, while columns
    are put together call by call."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hit_sql(keyword: str, folded: str = "folded", loosened: str = "loosened") -> str:
    """SQL of the test of keyword_hits() for one keyword, on columns by name."""
    loose = f" OR contains({loosened}, {literal(loose_keyword(keyword))})" if len(keyword.split()) > 1 else ""
    return f"(contains({folded}, {literal(keyword)}){loose})"


def excerpt(text: Column, folded: Column, label: Column, around: int = 420) -> Column:
    """The text around the place where its folded form holds the folded label; else its beginning.
    The place is counted in the folded form."""
    at = F.call_function("locate", label, folded)
    start = F.greatest(at - around, F.lit(1))
    found = F.substring(text, start, at - start + F.length(label) + around)
    return F.when((at > 0) & (label != ""), found).otherwise(F.substring(text, 1, 2 * around))


def without_prefix(text: Column, word: str) -> Column:
    """Lower case, white space collapsed, and one leading `word` dropped with the separators after it."""
    short = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), rf"(?i)^{word}[ \t:,-]*", "")
    return F.lower(F.trim(F.regexp_replace(short, r"[\x09-\x0d\x20]+", " ")))


def dedupe(values: Column) -> Column:
    """The first of those values that fold alike, in their order; what folds to nothing goes. Quadratic
    in the length of the list, so for short lists."""
    keys = F.transform(values, fold)
    return F.filter(values, lambda v, i: (fold(v) != "") & (F.array_position(keys, fold(v)) == i + 1))


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, braces within strings ignored; null if there is none."""
    tail = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*)", 1)
    start = F.struct(*(F.lit(v).alias(n) for n, v in (("depth", 0), ("quoted", False), ("escaped", False), ("at", 0), ("end", 0))))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closed = (s["end"] == 0) & ~s["quoted"] & (c == "}") & (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            (s["at"] + 1).alias("at"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return F.when(end > 0, F.substring(tail, F.lit(1), end))


def json_object(text: Column) -> Column:
    """The JSON object of an answer, as a string that can be parsed: the text without a code fence, else
    the widest {...} in it, else the first balanced one; null if none can be parsed."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    widest = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    fine = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(F.ltrim(c), F.lit("{")), c)
    return F.coalesce(fine(bare), fine(widest), fine(first_object(bare)))


def plain_name(text: Column) -> Column:
    """A name in lower case, common French accents off, punctuation as spaces, white space collapsed."""
    c = F.translate(F.lower(F.coalesce(text, F.lit(""))), "éèêàùïîç", "eeeauiic")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[()\[\]{}.,;:/\\_-]+", " "), r"\s+", " "))


def narrow_lower(text: Column) -> Column:
    """Lower case with the accents of French table labels off; other characters stay."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "éèêëàâîïôû", "eeeeaaiiou")


def entry_id(parts: list[Column]) -> Column:
    """Slugs of the parts that aren't blank, joined by _."""
    slugs = F.array(*(F.when(F.trim(F.coalesce(p.cast("string"), F.lit(""))) != "", slugify(p.cast("string"))) for p in parts))
    return F.array_join(F.filter(slugs, lambda x: x.isNotNull()), "_")


def cache_name(issuer: Column, year: Column, report: Column, ending: str = "pdf") -> Column:
    return F.concat(slugify(issuer), F.lit("_"), year.cast("string"), F.lit("_"), slugify(report), F.lit(f".{ending}"))


def first_filled(values: list[Column]) -> Column:
    """The first value that isn't blank, trimmed; null if there is none."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def optional_int(value: Column) -> Column:
    """Whole numbers, also written as 3.0 or with spaces around; null for all else."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number).try_cast("int")


def optional_float(value: Column) -> Column:
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def fine_items(values: Column, cast) -> Column:
    """The items of a list that `cast` can read."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), cast), lambda x: x.isNotNull())


def labelled_text(fields: dict[str, Column], body: Column) -> Column:
    """The text of a page for retrieval: `name: value` of each field (lists joined by spaces), then the
    page's own text."""
    parts = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in fields.items()]
    return F.concat_ws(" ", *parts, F.concat(F.lit("page text: "), F.coalesce(body, F.lit(""))))
