"""Paginated documents as a data source, keyword tables of any size, and versions of results."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import loose_keyword, with_folded
from pagemill.operators import history
from pagemill.operators.keywords import keyword_rows
from pagemill.sources import paged, pages


@pytest.fixture
def folder(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.txt").write_text("first page\n  indented line\f%size 300 400\nsecond\n\nafter a gap\f")
    (tmp_path / "sub" / "long.txt").write_text("\f".join(f"page {i} " + "x" * 50 for i in range(1, 201)))
    (tmp_path / "sub" / "empty.txt").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def load(spark, path, **options):
    return spark.read.format("paged_documents").options(**options).option("path", path)


def test_pages_lines_and_sizes(spark, folder):
    found = {(r.pdf_id, r.page_number): r for r in load(spark, folder).load().collect()}
    assert len(found) == 2 + 200 + 1
    assert found["one", 1].page_text == "first page\nindented line" and (found["one", 1].width, found["one", 1].height) == (595.0, 842.0)
    assert (found["one", 2].width, found["one", 2].height, found["one", 2].page_count) == (300.0, 400.0, 2) and found["empty", 1].page_text == ""
    lines = load(spark, f"{folder}/one.txt", output="lines").load().orderBy("page_number", "line").collect()
    assert [(r.page_number, r.line, r.x0, r.y0, r.text) for r in lines] == [(1, 0, 0.0, 0.0, "first page"), (1, 1, 12.0, 12.0, "indented line"), (2, 0, 0.0, 12.0, "second"), (2, 1, 0.0, 36.0, "after a gap")]
    counts = {r.pdf_id: r.page_count for r in load(spark, folder, output="documents").load().collect()}
    assert counts == {"one": 2, "long": 200, "empty": 1}


def test_large_files_are_read_by_several_tasks(spark, folder):
    whole = load(spark, folder, split_bytes="1000").load()
    assert whole.rdd.getNumPartitions() > 8
    assert whole.count() == 203 and whole.select("pdf_id", "page_number").distinct().count() == 203


def test_columns_are_chosen_by_schema(spark, folder):
    few = load(spark, folder, parser="tests.test_sources:no_text").schema("pdf_id string, page_number int").load()
    assert few.count() == 3 and few.columns == ["pdf_id", "page_number"]
    with pytest.raises(Exception, match="no such columns: colour"):
        load(spark, folder).schema("colour string").load().collect()


def no_text(data):
    """A parser whose lines can't be read."""
    return paged.Document(1, lambda i: 1 / 0, lambda i: 1 / 0)


def test_what_is_missing_or_broken_is_an_error(spark, folder):
    with pytest.raises(Exception, match="no such document: .*missing.txt"):
        load(spark, f"{folder}/missing.txt").load().collect()
    with pytest.raises(Exception, match="one.txt can't be read"):
        load(spark, f"{folder}/one.txt", parser="tests.test_sources:no_text").load().collect()


def test_filters_reach_the_reader(spark, folder):
    rows = load(spark, folder, split_bytes="1000").load().filter("pdf_id = 'long' AND page_number > 150 AND page_number <= 153")
    assert sorted(r.page_number for r in rows.collect()) == [151, 152, 153]
    reader = paged.Reader(load(spark, folder).load().schema, {"path": folder})
    list(reader.pushFilters([paged.EqualTo(("pdf_id",), "one"), paged.GreaterThan(("page_number",), 1)]))
    assert [s.files for s in reader.partitions()] == [[(f"{folder}/one.txt", 0, 1)]] and reader.first == 2


@pytest.mark.parametrize("part", [1 << 18, 3000])
def test_keyword_tables_of_any_size(spark, part):
    r = random.Random(4)
    letters = "abcdé "
    words = ["".join(r.choices("abcd", k=r.randint(1, 5))) for _ in range(300)]
    table = [(r.choice(["k1", "k2", None]), r.choice(["x", "y"]), i, " ".join(r.choices(words, k=r.randint(1, 3)))) for i in range(20_000)]
    table += [("k1", "x", 1, ""), ("k1", "y", 2, "ab,  cd"), ("k2", "x", 3, "- -"), ("k2", "y", 4, None), ("k1", "x", 5, "abc"), ("k1", "x", 6, "abc")]
    docs = [(i, "".join(r.choices(letters, k=r.randint(0, 60))) + r.choice(["", " ab,  cd", " ab - cd"])) for i in range(12)] + [(90, None), (91, "")]
    texts = with_folded(spark.createDataFrame(docs, "id long, text string"))
    got = keyword_rows(texts, spark.createDataFrame(table, "kind string, name string, ord int, keyword string"), ["id"], part).collect()
    want = {}
    for row in texts.collect():
        for kind, name, _, k in table:
            if k is not None and (k in row.folded or (len(k.split()) > 1 and loose_keyword(k) in row.loosened)):
                want[row.id, kind, name] = want.get((row.id, kind, name), 0) + 1
    assert {(x.id, x.kind, x.name): x.hits for x in got} == {k: n for k, n in want.items() if n}


def test_versions_of_a_key_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK_MICROS", 1_000_000)
    rows = [("k", f"2024-01-01 00:00:0{i}", i, f"v{i}", None if i % 2 else f"m{i}") for i in range(9)] + [(None, "2024-01-01 00:00:00", 0, "n0", None), (None, "2024-01-02 00:00:00", 1, "n1", None)]
    df = spark.createDataFrame(rows, "key string, at string, tie int, value string, model string").withColumn("at", F.col("at").cast("timestamp"))
    got = history.replaced(df, ["key"], "at", ["value"], "model", ["value"]).collect()
    assert {(r.key, r.value, r.new_value) for r in got} == {("k", f"v{i}", f"v{i + 1}") for i in range(8)} | {(None, "n0", "n1")}
    seen = {r.key: (r.value, r.model) for r in history.as_of(df, ["key"], "at", "tie", ["value", "model"], F.lit("2024-01-01 00:00:05").cast("timestamp")).collect()}
    assert seen == {"k": ("v5", "m4"), None: ("n0", None)}


def test_files_of_overrides_and_cases(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"emetteur": "Alpha", "aliases": ["A. Corp"], "year": 2024, "type_rapport": "Rapport 1er semestre", "type_comptes": "consolidés", "url": " https://x/a.pdf "}, "odd", 7, {"emetteur": "Beta", "year": 2023, "url": "https://x/b.pdf"}, {"emetteur": "None", "url": ""}]')
    rows = pages.overrides(spark, str(tmp_path / "o.json")).collect()
    assert [tuple(r) for r in rows] == [(0, "Alpha", ["A. Corp"], 2024, "s1", "consolidated", "https://x/a.pdf"), (3, "Beta", [], 2023, "annuel", None, "https://x/b.pdf")]
    assert pages.overrides(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "broken.json").write_text("{nothing")
    assert pages.overrides(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "c.json").write_text('{"cases": [{"id": "one", "company": "Alpha", "expected_page": 12}, {"id": "two"}]}')
    (tmp_path / "l.json").write_text('[{"id": "three", "year": 2024}]')
    assert [(r.pos, r.id, r.expected_page) for r in pages.cases(spark, str(tmp_path / "c.json")).collect()] == [(0, "one", 12), (1, "two", None)]
    assert [(r.id, r.year) for r in pages.cases(spark, str(tmp_path / "l.json")).collect()] == [("three", 2024)]
