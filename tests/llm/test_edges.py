"""Rows that once broke an operator: very long roles, very many equal rows, rules and candidates in parts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, packing, queries, records, toxicity, urls


@pytest.mark.parametrize("role", ["r" * 1_000_000, ":" * 300_000, "\\" * 300_001, "\\:# " * 100_000, None, "", ": "])
def test_roles_of_any_length(spark, role):
    rows = [(1, 0, role, "hi"), (1, 1, "assistant", ": ok"), (2, 0, "assistant", "alone")]
    got = {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    whole = f"{role or ''}\nhi\nassistant\n: ok\n"
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].n_turns == 2
    assert got[1].loss_sha256 == hashlib.sha256(b": ok").hexdigest()


def equal_rows(spark, n):
    return spark.range(0, n, 1, 3).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words in each row").alias("text"))


def test_equal_rows_are_packed_in_many_shards(spark):
    got = packing.pack_documents(equal_rows(spark, 20_000), queries.BPE, 2, 1024, 1000)
    shards = got.groupBy(F.shiftright("sequence_id", 32)).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert shards[0] == 20 and shards[1] < 1400 and shards[2] == 20_000


def test_equal_rows_fill_many_files(spark, tmp_path):
    docs = equal_rows(spark, 20_000)
    records.write(docs, queries.BPE, 0, str(tmp_path), 50_000)
    sizes = spark.read.parquet(f"{tmp_path}/index").groupBy("file").count().select("count").collect()
    assert len(sizes) >= 9 and max(r[0] for r in sizes) < 6000
    got = records.read(spark, str(tmp_path), False).agg(F.count("*"), F.max("start") + F.max("n_tokens"), F.sum("n_tokens")).first()
    assert got[0] == 20_000 and got[1] == got[2]


def test_candidates_in_parts_give_the_same_verdicts(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a"), F.col("id") % 50, F.lit(".example.COM/en/"), "id").alias("url"))
    whole = sorted(map(tuple, urls.judge(pages, queries.URL_RULES).collect()))
    assert sorted(map(tuple, urls.judge(pages, queries.URL_RULES, max_bytes=0, part_names=7).collect())) == whole


def test_rule_hosts_are_folded_like_urls(spark):
    pages = spark.createDataFrame([(1, "http://É.COM/"), (2, "http://é.com/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [("É.Com", "/", "block")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_rare_features_are_kept_whole(spark):
    """Two toxic documents with 80 words of their own: under the least number of documents, and no cap on features."""
    foul = " ".join(f"foul{a}{b}word" for a in "abcdefgh" for b in "abcdefghij")
    rows = [(i, foul + f" tail{i}" if i in (1, 2) else f"plain text of number {i}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(i, int(i in (1, 2))) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", mod=1000, held_out=999)
    assert len(model.keys) > 80
    got = {r["doc.doc_id"]: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert min(got[1], got[2]) > 0.5 > max(v for k, v in got.items() if k not in (1, 2))
