"""The kept index: equal scores, blocks left unread, builds of changed documents only, vectors with errors."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import page_index, retrieval
from pagemill.sources import shared
from pagemill.sources.vectors import Encoder, encoded


def docs(spark, n=600, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, r.choice(["a", "b", None, "big", "big"]), " ".join(r.choices(words, weights=range(1, 61), k=r.randint(0, 80)))) for i in range(n)]
    rows += [(900, "a", None), (901, None, ""), (5, "big", "w1 w1 w1"), (5, "big", "w1 w2")]
    return spark.createDataFrame(rows, "page long, grp string, text string")


def queries(spark):
    rows = [(1, "w1", 1), (1, "w2", 2), (1, "w59", 1), (2, "w50", 1), (2, "w3", 3), (3, "unknown", 1), (4, "w1", 1)]
    return spark.createDataFrame(rows, "query_id long, term string, weight int")


def rounded(rows):
    return sorted((r.query_id, str(r.grp), r.rank, r.page, r.score) for r in rows)


@pytest.mark.parametrize("k", [3, 40])
def test_top_k_equals_scoring_all(spark, k):
    pages = docs(spark)
    index = page_index.fresh(spark, 4)
    now = index.update(pages, "grp", "page", "text", page_index.page_key(["grp", "page", "text"]))
    found, plan = index.top_k(index.documents(now), queries(spark), k)
    single = pages.withColumn("row", F.monotonically_increasing_id())
    every = retrieval.bm25(single, "row", "grp", "text", queries(spark)).join(single.select("row", "page"), "row")
    want = retrieval.top_k(every.select("query_id", "grp", "page", F.round("bm25", 5).alias("score")), ["query_id", "grp"], "score", ["page"], k)
    assert rounded(found.collect()) == rounded(want.collect())
    ways = {r.way: r.s for r in plan.groupBy("way").agg(F.sum("size").alias("s")).collect()}
    if k == 3:
        assert ways["unread"] > 0


def test_second_run_builds_changed_documents_only(spark):
    pages = docs(spark)
    index = page_index.fresh(spark, 4)
    version = F.xxhash64("page", "text")
    first = index.update(pages.withColumn("v", version), "grp", "page", "text", F.col("v"))
    assert {r.grp: r.built for r in first.collect()} == {"a": True, "b": True, None: True, "big": True}
    size = index.table("postings").count()
    # No text is read: reading one would fail.
    unread = pages.withColumn("v", version).withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    second = index.update(unread.repartition(3), "grp", "page", "text", F.col("v"))
    assert {r.built for r in second.collect()} == {False} and index.table("postings").count() == size
    changed = pages.withColumn("text", F.when(F.col("grp") == "b", F.concat("text", F.lit(" extra"))).otherwise(F.col("text")))
    third = index.update(changed.withColumn("v", version), "grp", "page", "text", F.col("v"))
    assert {r.grp: r.built for r in third.collect()} == {"a": False, "b": True, None: False, "big": False}
    asked = spark.createDataFrame([(1, "extra", 1)], "query_id long, term string, weight int")
    assert {r.grp for r in index.top_k(index.documents(third), asked, 2)[0].collect()} == {"b"}
    assert index.top_k(index.documents(first), asked, 2)[0].count() == 0  # the documents as they were
    again = page_index.PageIndex(spark, index.path, 4)
    assert again.documents(third).count() == 4


def test_postings_are_joined_where_they_lie(spark):
    index = page_index.fresh(spark, 4)
    now = index.update(docs(spark), "grp", "page", "text", page_index.page_key(["text"]))
    asked = queries(spark)
    rows = index.bounds(index.documents(now), asked)
    plan = index._asked(asked, ["gid", "block", "term", "size"]).groupBy("query_id", "gid", "block").agg(F.sum("size"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and rows.count() > 0


def letters():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no such word")
        return [[t.count("a"), t.count("b"), len(t)] for t in texts]

    return encode


def test_failures_cost_no_other_vector(spark):
    rows = spark.createDataFrame([(i, "bad" if i % 7 == 0 else None if i == 3 else "ab" * i) for i in range(50)], "k long, text string").repartition(2)
    got = {r.k: (r.vector, r.error) for r in encoded(rows, "text", Encoder("letters", letters, 8)).collect()}
    assert len(got) == 50 and got[3] == ([0.0, 0.0, 0.0], None) and got[4] == ([4.0, 4.0, 8.0], None)
    assert {k for k, (v, e) in got.items() if v is None} == set(range(0, 50, 7))
    assert all(e == "RuntimeError: no such word" for v, e in got.values() if v is None)


def test_wrong_answers_are_errors():
    short = Encoder("short", lambda: lambda texts: [[1.0]] * (len(texts) if len(texts) < 3 else 1), 4)
    assert short(["a", "b", "c", "d"]) == ([[1.0]] * 4, [None] * 4)
    broken = Encoder("broken", lambda: 1 / 0)
    assert broken(["a", "b"])[1] == ["ZeroDivisionError: division by zero"] * 2
    assert Encoder("nan", lambda: lambda t: [[float("nan")]] * len(t))(["a"])[1] == ["ValueError: a component that isn't finite"]


def test_vectors_are_kept(spark):
    index = page_index.fresh(spark, 4)
    now = index.update(docs(spark, 50), "grp", "page", "text", page_index.page_key(["text"]), Encoder("letters", letters))
    found = index.table("vectors").join(index.documents(now), "gid")
    assert found.count() == docs(spark, 50).count() and found.filter("vector IS NULL").isEmpty()


def test_what_was_kept_can_be_cleared(spark):
    mine = shared._FOLDERS.pop(spark.sparkContext.applicationId, [])  # what other tests still read
    try:
        rows = shared.kept(spark.range(5), "few")
        path = shared._FOLDERS[spark.sparkContext.applicationId][0].removeprefix("file://")
        assert rows.count() == 5 and os.path.isdir(path)
        assert shared.clear(spark) == 1 and not os.path.exists(path)
    finally:
        shared._FOLDERS[spark.sparkContext.applicationId] = mine
