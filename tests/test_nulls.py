"""Null group keys go through every grouped operator: a null is a group, and no row is lost."""

from pyspark.sql import functions as F

from pagemill.functions.text import with_folded
from pagemill.operators import classify, geometry, linking, retrieval, scoring, tables
from pagemill.operators.ordered import with_neighbours
from pagemill.plans import statements

ROWS = [(1, None, "en", 1.0), (2, None, "en", 3.0), (3, "a", None, 5.0), (4, "a", None, 9.0), (5, "a", "en", 2.0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "id long, source string, lang string, x double")


def test_minmax_and_fallback(spark):
    got = {r.id: r.x for r in retrieval.minmax(frame(spark), ["source", "lang"], "x").collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0}
    kept = retrieval.keep_or_all(frame(spark), ["source", "lang"], F.col("x") > 2.5).collect()
    assert sorted(r.id for r in kept) == [2, 3, 4, 5]
    unknown = retrieval.keep_or_all(frame(spark), ["source"], F.lit(None).cast("boolean")).collect()
    assert len(unknown) == 5


def test_bm25(spark):
    docs = spark.createDataFrame([(1, None, "red fish"), (2, None, "blue fish"), (3, "a", "red red"), (4, "a", None)], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(0, "red", 1)], "query_id long, term string, weight int")
    got = {r.doc_id: r.source for r in retrieval.bm25(docs, "doc_id", "source", "text", asked).collect()}
    assert got == {1: None, 3: "a"}


def test_neighbours_and_scopes(spark):
    pages = spark.createDataFrame([(None, 1, "consolide"), (None, 2, "x"), ("d", 1, "x"), ("d", None, "comptes sociaux"), ("d", 2, None)], "doc string, page long, text string")
    got = {(r.doc, r.page): (r.previous_text, r.next_text) for r in with_neighbours(pages, "doc", "page", ["text"]).collect()}
    assert got == {(None, 1): (None, "x"), (None, 2): ("consolide", None), ("d", None): (None, "x"), ("d", 1): ("comptes sociaux", None), ("d", 2): ("x", None)}
    words = {"consolidated": ["consolide"], "statutory": ["comptes sociaux"]}
    scopes = {(r.doc, r.page): r.scopes for r in classify.scope_ranges(pages, "doc", "page", "text", words).collect()}
    assert scopes == {(None, 1): ["consolidated"], (None, 2): ["consolidated"], ("d", None): ["statutory"], ("d", 1): ["statutory"], ("d", 2): ["statutory"]}


def test_bounds_pairs_and_ranks(spark):
    lines = spark.createDataFrame([(None, 100.0, 110.0, "end"), (None, 60.0, 70.0, "total"), ("p", 5.0, 9.0, "total")], "page string, y0 double, y1 double, kind string")
    got = {r.page: (r.first_boundary, r.end_anchor, r.y_end) for r in geometry.bounds_below(lines, ["page"], "y0", "y1", F.lit(0.0), F.col("kind") == "end", F.col("kind") == "total").collect()}
    assert got == {None: (100.0, 70.0, 74.0), "p": (None, 9.0, 13.0)}
    pairs = geometry.nearest_pair(lines.filter("kind = 'end'"), lines.filter("kind = 'total'"), ["page"], "y0", "y0", 50.0).collect()
    assert [(r.page, r.dy) for r in pairs] == [(None, 40.0)]


def test_requests_on_pages_without_a_document(spark):
    rows = [(1, None, "Bilan actif consolide", "bank"), (2, None, "comptes sociaux annexe", "bank"), (None, "s", "x", None), (3, "s", None, "other")]
    pages = with_folded(spark.createDataFrame(rows, "doc_id long, source string, text string, sector string"))
    pages = pages.withColumn("scopes", F.array().cast("array<string>")).withColumn("titles", F.array().cast("array<string>"))
    asked = scoring.requested(scoring.page_features(pages, "source", "doc_id"), statements.REQUESTS)
    assert asked.count() == 4 * len(statements.REQUESTS)
    assert {r.source for r in scoring.same_scope_or_all(asked, ["query_id", "source"]).select("source").collect()} == {None, "s"}


def test_search_results_and_tables(spark):
    found = spark.createDataFrame([(None, 0, 0, "u"), (None, 1, 0, "v"), ("g", 2, 0, "w")], "grp string, source_rank int, pos int, url string")
    assert {(r.grp, r.url) for r in linking.first_urls(found, ["grp"], 5).collect()} == {(None, "u"), ("g", "w")}
    results = spark.createDataFrame([(None, "asset", "x"), ("d", "asset", "x"), ("d", "income", "x")], "doc string, target string, scope string")
    assert [r.doc for r in tables.complete(results, "doc", ["asset", "income"], ["x"]).collect()] == ["d"]
    assert sorted(str(r.doc) for r in tables.complete(results, "doc", ["asset"], ["x"]).collect()) == ["None", "d"]
