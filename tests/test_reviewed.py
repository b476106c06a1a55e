"""Cases that reviews of larger tables brought up: rare values that small tables don't hold, and work that grew faster
than its tables."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import keywords, layout, linking, tables
from pagemill.plans import queries as plans
from tests.compare import connect, differences


@contextmanager
def most_rows(spark):
    """Gives a list that then holds the greatest number of rows that any step of the queries inside gave."""
    bus, store = spark._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before, found = store.executionsCount(), []
    yield found
    bus.waitUntilEmpty()
    runs = store.executionsList()
    most = 0
    for e in (runs.apply(i) for i in range(before, runs.size())):
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for metrics in (nodes.apply(i).metrics() for i in range(nodes.size())):
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    found.append(most)


def test_customer_zero_is_a_page(spark, tmp_path):
    rows = [(2 + 6 * i, i % 3) for i in range(24)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert differences(plans.QUERIES["friendly_errors"](spark, str(tmp_path)), connect(str(tmp_path)), plans.ORACLES["friendly_errors"]) == ""
    page = spark.range(2).select(tables.friendly_error(F.lit("target_not_found"), F.lit("asset"), F.col("id"), F.lit(False)).alias("m"))
    assert {r.m for r in page.collect()} == {"Assets: the table was not found", "Assets: the table was not found (page 1)"}


def test_table_ends_by_a_line_below_the_page(spark, tmp_path):
    spark.createDataFrame([(18305,), (21000,), (23695,), (7,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert differences(plans.QUERIES["table_bottom"](spark, str(tmp_path)), connect(str(tmp_path)), plans.ORACLES["table_bottom"]) == ""
    end = lambda typed: layout.bottom(F.lit(840.0), F.lit(typed).cast("double"), F.lit(862.0), F.lit(842.0))
    assert spark.range(1).select(end(None).alias("a"), end(840.0).alias("b")).first() == (846.0, 840.0)


def test_long_addresses_are_unwrapped(spark, tmp_path):
    rows = [(i, "https://a.example/" + "x" * n) for i, n in enumerate((20, 38, 39, 40, 57, 58, 59, 300))]
    rows = [(3 * i + k, u) for i, u in rows for k in range(3)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert differences(plans.QUERIES["url_unwrap"](spark, str(tmp_path)), connect(str(tmp_path)), plans.ORACLES["url_unwrap"]) == ""
    odd = spark.createDataFrame([("https://b.example/ck?u=a1aHR0\r\ncDovL2E&n=2",), ("https://a\n.example/",)], "u string")
    assert [r.t for r in odd.select(linking.unwrapped(F.col("u")).alias("t")).collect()] == ["http://a", "https://a\n.example/"]


def test_equal_names_are_matched_once(spark):
    names = ["atlas delta mines", "banque du nord", None, "ka", "atlas delta mines"] * 40
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "a long, x string")
    right = spark.createDataFrame([(900 - i, "atlas delta mines nord") for i in range(300)] + [(5000 - i, "nord banque") for i in range(300)], "b long, y string")
    with most_rows(spark) as most:
        got = {(r.a, r.b, r.score) for r in linking.best_match(left, right, "a", "x", "b", "y").collect()}
    assert got == {(i, 601, 80) for i in range(200) if i % 5 in (0, 4)} | {(i, 601, 75) for i in range(200) if i % 5 == 1}
    assert most[0] < 2000  # 24,000 pairs of rows share words


def test_equal_requests_meet_overrides_once(spark):
    rows = spark.createDataFrame([(i, f"http://o/{i}", "Atlas Mines", None, 2024, "s1", [None, "", "consolidated", "statutory"][i % 4] if i >= 40 else "statutory") for i in range(400)], "pos long, url string, issuer string, aliases array<string>, year long, report string, scope string")
    asked = spark.createDataFrame([(i, "ATLAS mines" if i % 5 else None, 2024, "s1", ["consolidated", "statutory", None][i % 3]) for i in range(400)], "k long, issuer string, year long, report string, scope string")
    with most_rows(spark) as most:
        got = {r.k: r.url for r in linking.overrides(asked, rows, "k").collect()}
    assert got == {i: ["http://o/40", "http://o/0", "http://o/40"][i % 3] for i in range(400) if i % 5}
    assert most[0] <= 800  # 128,000 pairs of rows have the same name


def test_blends_rank_without_all_pairs(spark, tmp_path):
    texts = ["the and, the tion", "of the nation le", "x", None, "der die le the"]
    docs = [(i, f"s{i % 2 if i < 600 else 2}", "en", texts[i * 7 % 5]) for i in range(700)]
    vectors = [(i, 0, None if i in (100, 7) else [1.0, 2.0, 0.5] if i % 3 == 0 else [float(i % 17), float(i * i % 23) - 9, float(i % 5)]) for i in range(610)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(str(tmp_path))
    for name in ("hybrid_blend", "tiebreak_rerank"):
        with most_rows(spark) as most:
            assert differences(plans.QUERIES[name](spark, str(tmp_path)), con, plans.ORACLES[name]) == ""
        assert most[0] < 2000  # 9,100 pairs of a document and a query


def test_keywords_that_no_text_holds_take_no_scan(spark, monkeypatch):
    texts = ["order 1234567 and 98 of hot bolt", "a large ring, old plate", "", None, "12345678901234567890 x"]
    pages = T.with_folded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "folded", "loosened")
    words = [str(n) for n in (*range(100), *range(1234560, 1234570), 234567, 34567, 12345678, 123456789012, 2345678901234, 7654321)] + ["hot  bolt", "ring, old", "ring old", "old-plate x", "large, ring", "", "é", "bolt hot"]
    words += [f"no such {i}" for i in range(300)] + [str(n) for n in range(50_000_000, 50_000_300)]
    table = spark.createDataFrame([("k", w, w) for w in words], "kind string, name string, keyword string")
    whole = {tuple(r) for r in keywords.keyword_rows(pages, table, ["doc_id"]).collect()}
    made = []
    monkeypatch.setattr(keywords, "kept", lambda rows, name, keep=keywords.kept: (made.append(name), keep(rows, name))[1])
    assert {tuple(r) for r in keywords.keyword_rows(pages, table, ["doc_id"], part=200).collect()} == whole
    assert (0, "k", "1234567", 1) in whole and (4, "k", "2345678901234", 1) in whole and (1, "k", "ring old", 1) in whole
    assert made.count("hits") <= 1  # 4 parts of all keywords, 1 of those that texts may hold


def test_many_queries_take_no_row_for_each_document(spark, tmp_path):
    words = [f"w{i}" for i in range(12)]
    docs = [(i, f"s{i % 2}", "en", " ".join(words[(i * j) % 12] for j in range(1 + i % 6)) if i % 9 else [None, "", "zz"][i % 3]) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(words[(i + j) % 12] for j in range(4)) + " none") for i in range(40)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with most_rows(spark) as most:
        assert differences(plans.QUERIES["bm25_multi_query"](spark, str(tmp_path)), connect(str(tmp_path)), plans.ORACLES["bm25_multi_query"]) == ""
    assert most[0] < 1500  # over 7,000 pairs of a document's term and a query
