"""Operator 13 against plain counting, on texts with odd bytes and few words."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import collocations

SCHEMA = "doc_id long, lang string, text string, n long"


def plain(rows, least=10, top=2000):
    f, total = Counter(), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[(lang, *ws[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    best = {}
    for (lang, *ws), a in candidates.items():
        longer = [b for (other, *xs), b in candidates.items() if other == lang and len(xs) > len(ws) and any(xs[i : i + len(ws)] == ws for i in range(len(xs) - len(ws) + 1))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[(lang, *ws[:k])], f[(lang, *ws[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), left, right))
    out = []
    for lang, own in best.items():
        for rank, (s, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def fixture():
    r = random.Random(7)
    words = ["the", "The", "of", "big", "cat", "cat", "dog", "é", "É", "日本", "x" * 70, " ", "a", "a", "a"]
    join = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r", "\x0b", "!", ":", "? "]
    rows = []
    for i in range(400):
        text = "".join(r.choice(words) + r.choice(join) for _ in range(r.randint(0, 25)))
        rows.append((i, r.choice(["en", "en", "fr", None, "und", ""]), text, 3))
    return [*rows, (1, "en", None, 1), (1, None, "", 1), (2, "en", "a " * 30_000, 1), (3, "fr", "the big cat " * 12, 1), (4, "de", "one two three four", 1)]


@pytest.mark.parametrize("held,share", [(1 << 20, 1000), (50, 1000), (500, 10)])
def test_phrases_match_plain_counts(spark, monkeypatch, held, share):
    monkeypatch.setattr(collocations, "RANKED", 8)
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = collocations.mine(docs, top=40, held=held, share=share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == plain(rows, top=40)


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None, 1), (2, "en", " . ", 1)], SCHEMA)).collect() == []


def test_numbers_differ_by_salt_and_scores_are_exact(spark):
    buf = np.frombuffer(b"abc", np.uint8)
    starts, lens = np.arange(3), np.ones(3, np.int64)
    seen = [collocations.number(buf, starts, lens, s) for s in range(3)]
    assert len({int(x) for own in seen for x in own}) == 9
    a, left, right = 9_999_999_999_999, 99_999_999_999_989, 99_999_999_999_971
    got = spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first().s
    assert got == 1000000 * a * a // (left * right)


def test_words_that_share_a_number_get_others(spark, monkeypatch):
    """Where a first hash gives two words one number, another is taken."""
    docs = spark.createDataFrame([(1, "en", "p q " * 20, 1)], SCHEMA).select("lang", "text")
    words = collocations._words
    monkeypatch.setattr(collocations, "_words", lambda d, salt, most: words(d, salt, most) if salt else words(d, 0, most).withColumn("last", F.lit("another")))
    collocations.ship(spark)
    found, salt = collocations.words_of(docs)
    assert salt == 1 and sorted((r.word, r.n) for r in found.collect()) == [("p", 20), ("q", 20)]
