"""Fixed cases of evidence rows, candidate ranks and widening; layouts against plain Python; sources,
sinks, retries and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import feedback, geometry, layout, ordered, requests, retrieval, tables
from pagemill.plans import layouts
from pagemill.sources import pages
from pagemill.streaming import jobs

DIR = "/root/testdata/sf0.001"


def test_one_row_gives_one_chunk(spark):
    schema = "company string, selected_page int, columns array<string>, rows array<struct<label:string,row_type:string,values:map<string,string>>>, evidence array<string>, page_text string"
    result = spark.createDataFrame([("Sample Co", 12, ["2024", "2023"], [("Total actif", "total", {"2024": "1 000"})], ["anchor:Total actif"], "Le Total actif est visible sur la page.")], schema)
    rows = tables.evidence_rows(result, ["company", "selected_page", "evidence", "page_text"], "columns", "rows")
    text = tables.chunk_text({"Company": F.col("company"), "Page": F.col("selected_page").cast("string"), "Row": F.col("label")}, F.col("row_type"), {"2024": F.element_at("values", "2024"), "2023": F.element_at("values", "2023")})
    rows = rows.withColumn("f", T.fold(F.col("page_text")))
    r = rows.select("*", text.alias("text"), T.excerpt(F.col("page_text"), F.col("f"), T.fold(F.col("label"))).alias("excerpt")).collect()
    assert len(r) == 1 and r[0].row_index == 1 and r[0].selected_page == 12 and r[0].evidence == ["anchor:Total actif"]
    assert r[0].text == "Company: Sample Co | Page: 12 | Row: Total actif | type: total | 2024: 1 000 | 2023: " and "Total actif" in r[0].excerpt
    assert r[0]["values"] == {"2024": "1 000", "2023": ""}
    assert tables.evidence_rows(result.withColumn("columns", F.array().cast("array<string>")), ["company"], "columns", "rows").count() == 0


def test_label_signature_beats_a_weak_page(spark):
    candidates = spark.createDataFrame([("doc", 182, 0.494, True, True, True), ("doc", 161, 0.35, True, False, False)], "pdf string, page int, confidence double, income boolean, whole_page boolean, titled boolean")
    scores = spark.createDataFrame([("doc", 182, 0.494, 1.0, 0.0, 0.005), ("doc", 161, 0.480, 1.0, 0.419, 0.382)], "pdf string, page int, score double, scope_score double, sig double, anchor_score double")
    got = {r.page: (r["rank"], round(r.rank_score, 5)) for r in geometry.ranked_candidates(candidates, scores, ["pdf"], "page").collect()}
    assert got == {161: (1, 0.56924), 182: (2, 0.31065)}


def test_rich_signature_is_localized_beyond_the_cut(spark):
    rows = [(166, 1, 0.0, 0.027), (170, 2, 0.0, 0.0), (182, 3, 0.0, 0.005), (171, 4, 0.0, 0.0), (161, 5, 0.419, 0.382), (162, 6, 0.29, 0.24)]
    df = spark.createDataFrame(rows, "page int, rank int, signature double, anchor double")
    got = retrieval.widened(df, 4, F.col("signature"), F.col("anchor"), F.lit(True)).orderBy("rank")
    assert [r.page for r in got.collect()] == [166, 170, 182, 171, 161]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_neighbours_over_blocks(spark, block):
    rows = [(d, p, (p * 7 + d) % 3) for d in range(3) for p in range(0, 40, 1 + d)]
    got = ordered.with_neighbours(spark.createDataFrame(rows, "d int, p int, v int"), "d", "p", ["v"], block).collect()
    at = {(d, p): v for d, p, v in rows}
    assert len(got) == len(rows)
    for r in got:
        step = 1 + r.d
        assert (r.previous_v, r.next_v) == (at.get((r.d, r.p - step)), at.get((r.d, r.p + step)))


def plain_localize(lines, blocks, target, score, scope_score, labels):
    """The whole of layout.localized for a balance sheet, line by line."""
    w, width, height = layout.WORDS, layouts.WIDTH, layouts.HEIGHT
    lines = sorted(lines)
    own, other = w.header[target], w.header[layout.OTHER[target]]
    has = lambda t, ws: any(x in t for x in ws)
    mid = lambda x: (x[1] + x[2]) / 2
    page = " ".join(x[5] for x in lines)
    if "ventilation" in page[:4500] and "devise" in page[:4500]:
        return "none", None, None
    header = lambda t, h: t in [h + e for e in w.header_endings] or t.replace(" ", "") == h or t.startswith((f"{h} (", f"{h} au "))
    found = [x for x in lines if header(x[5], own)]
    if not found:
        social = [x for x in lines if x[5].startswith("bilan social")]
        found = social[:1] if target == "asset" else social[1:2]
    pairs = [(abs(a[0] - b[0]), i, j, mid(a), mid(b)) for i, a in enumerate(x for x in lines if header(x[5], "actif")) for j, b in enumerate(x for x in lines if header(x[5], "passif"))]
    column = None
    if pairs:
        dy, _, _, ca, cb = min(pairs)
        if dy <= 40 and abs(ca - cb) >= width * 0.2:
            split = max((ca + cb) / 2, width / 2)
            column = (0.0, split) if target == "asset" else (split, width)
    inside = lambda x, slack: column is None or column[0] - slack <= mid(x) <= column[1] + slack
    found = [x for x in found if inside(x, 5)]
    mine = [b for b in blocks if b[6] == target]
    if not found:
        return "rest", None, None

    def value(h):
        above = " ".join(x[5] for x in lines if h[0] - 90 <= x[0] <= h[0])
        below = " ".join(x[5] for x in lines if h[0] < x[0] <= h[0] + 260)
        v = 3 * has(above, w.before) + 3 * has(below, w.ends[target]) + sum(has(below, g) for g in w.rows_below)
        v += 2.5 * has(above, w.ends["asset"]) * (target == "liability")
        return v - 2 * (h[0] < 180 and not has(above, w.before[:-1]))

    head = found[0] if len(found) == 1 else max(found, key=value)
    if column is None:
        near = [x for x in lines if x[0] >= head[0] - 50 and x[5].startswith(w.split_titles + w.neighbour_titles)]
        right, left = [x[1] for x in near if mid(x) > width / 2 - 5], [x[2] for x in near if mid(x) < width / 2 + 5]
        if mid(head) < width / 2 - 20 and right:
            column = (0.0, max(width * 0.35, min(right) - 8))
        elif mid(head) > width / 2 + 20 and left:
            column = (min(width * 0.65, max(left) + 8), width)
    y = head[0]

    def title(t, kind):
        if kind == "income":
            return t.startswith(w.income_starts + w.income_titles)
        h = w.header[kind]
        return has(t, (f"bilan {h}", f"bilan ({h})", f"{h} ifrs")) or t == h or t.startswith(f"{h} (")

    def ends(t):
        side = t == other or t.startswith(other + " ")
        if target == "asset":
            return side or has(t, w.boundaries)
        if t.startswith("autres " + other) or ("gains et pertes" in t and "capitaux propre" in t):
            return False
        return has(t, w.boundaries) or (side and own not in t)

    typed = min([b[0] for b in blocks if b[0] > y + 12 and inside(b, 5) and b[6] and b[6] != target and title(b[5], b[6])], default=height)
    line = min([x[0] for x in lines if x[0] > y + 8 and inside(x, 5) and ends(x[5])], default=None)
    anchor = max([x[3] for x in lines if x[0] > y + 8 and inside(x, 5) and (line is None or x[0] < line) and has(x[5], w.ends[target])], default=None)
    first = min(typed, line) if line is not None else typed
    if anchor is not None:
        end = min(height, anchor + 4) if first <= anchor else min(anchor + 4, first - 2 if first < height else anchor + 4)
    else:
        end = max(0.0, first - 2) if first < height else height - 20
    loose = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t).split())
    matched = []
    for x in lines:
        if x[3] >= y - 45 and x[0] <= end + 8 and inside(x, 8):
            hit = next((n for n in labels if n in x[5] or loose(n) in loose(x[5])), None)
            if hit:
                matched.append((x[0], x[3], hit))
    names = {m[2] for m in matched}
    if matched and (len(names) >= max(4, int(len(labels) * 0.35)) or len(names) / len(labels) >= 0.35):
        runs = [[matched[0]]]
        for m in matched[1:]:
            if m[0] - runs[-1][-1][1] <= 95 or len(matched) <= 2:
                runs[-1].append(m)
            else:
                runs.append([m])
        best = max(runs, key=lambda r: (len({m[2] for m in r}), len(r)))
        y, end = min(y, min(m[0] for m in best)), max(end, min(height, max(m[1] for m in best) + 12))
    lo, hi = column or (0.0, width)
    for b in sorted(blocks):
        if y - 8 <= b[0] <= end + 5 and lo - 5 <= mid(b) <= hi + 5:
            lo, hi = min(lo, b[1]), max(hi, b[2])
    if column:
        lo, hi = max(lo, column[0]), min(hi, column[1])
    clamp = lambda v, top: min(max(v, 0.0), top)
    a, c = sorted((clamp(lo - 8, width), clamp(hi + (2 if column else 8), width)))
    b, d = sorted((clamp(max(0.0, y - 10), height), clamp(min(height, end), height)))
    conf = min(0.98, 0.78 + 0.2 * score)
    conf = min(conf, 0.45) if scope_score <= 0 else conf
    early = [x[5] for x in lines if x[0] <= y + 45][:8]
    main = any(t in w.header.values() or t.startswith(("bilan au", "bilan actif", "bilan passif")) for t in early)
    if d - b < 130:
        conf = min(conf, 0.70)
    if has(page, w.not_main):
        conf = conf if main else min(conf, 0.72)
        conf = min(conf, 0.62) if d - b < 180 else conf
    conf = min(conf, 0.58) if has(page, w.other_statement) else conf
    return "header", (a, b, c, d), conf


@pytest.mark.parametrize("target", ["asset", "liability"])
def test_localization_against_plain_python(spark, target):
    rows = layouts.pages(spark, DIR).withColumn("score", (F.col("doc_id") % 101) / 100.0).withColumn("scope_score", (F.col("doc_id") % 4) / 4.0)
    got = layout.localized(rows, target, layouts.LABELS[target]).select("doc_id", "lines", layout.typed(F.col("blocks")).alias("b"), "score", "scope_score", "way", "table", "confidence").collect()
    ways = {}
    for r in got:
        lines = [tuple(x) for x in r.lines]
        want = plain_localize(lines, [tuple(x) for x in r.b], target, r.score, r.scope_score, layouts.LABELS[target])
        ways[r.way] = ways.get(r.way, 0) + 1
        if want[0] == "rest":
            assert r.way in ("blocks", "page")
            continue
        assert r.way == want[0], r.doc_id
        if want[1]:
            assert pytest.approx(want[1]) == tuple(r.table), r.doc_id
            assert pytest.approx(want[2]) == r.confidence, r.doc_id
    assert ways["header"] > 20


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"emetteurs": [{"code": "1", "label": "A"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"code": "2", "label": "B"}]))
    assert sorted((r.code, r.label) for r in pages.issuers(spark, str(tmp_path / "*.json")).collect()) == [("1", "A"), ("2", "B")]
    (tmp_path / "m.txt").write_text(json.dumps({" x ": "bank", "y": "odd"}))
    assert [tuple(r) for r in pages.sector_map(spark, str(tmp_path / "m.txt")).collect()] == [("x", "bank")]
    chunks = tmp_path / "chunks.json"
    chunks.write_text(json.dumps([{"pdf_id": "p", "page_number": 1}, {"pdf_id": "p", "page_number": 2}]))
    schema = "pdf_id string, page_number int"
    assert pages.cached_pages(spark, str(chunks), schema, {"pdf_id": "p"}).count() == 2
    assert pages.cached_pages(spark, str(chunks), schema, {"pdf_id": "q"}) is None
    df = spark.createDataFrame([("a|b", 0.5, ["x", "y"], None), ("c", 0.25, [], 3)], "name string, share double, marks array<string>, n int")
    pages.write_csv(df, str(tmp_path / "csv"), ["marks"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("a|b", "0.5", "x; y", None), ("c", "0.25", None, "3")]
    pages.write_markdown(df, str(tmp_path / "md"), "Report", ["name", "share"], "name")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "md"), wholetext=False).collect())
    assert "| a\\|b | 0.500 |" in text and "| c | 0.250 |" in text and "# Report" in text
    pages.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    keys = {r.key for r in pages.page_index(df).collect()}
    assert len(keys) == 2 and keys == {r.key for r in pages.page_index(df.repartition(2)).collect()}
    (tmp_path / "page_7.png").write_bytes(b"x" * 2000)
    assert [(r.page_number, r.length) for r in pages.page_images(spark, str(tmp_path / "*.png")).collect()] == [(7, 2000)]
    got = pages.downloaded(spark.createDataFrame([("a", b"x" * 999), ("b", b"x" * 1048576)], "path string, content binary")).collect()
    assert [(r.fine, r.size_mb) for r in got] == [(False, 0.0), (True, 1.0)]


def test_models_fail_as_rows(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, "boom"), (3, None)], "k long, t string").coalesce(1)
    enc = pages.hashing_encoder(8)
    got = {r.k: r.vector for r in pages.encoded(rows, "k", "t", enc).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] == [0.0] * 8

    def broken(texts):
        raise RuntimeError("no model")

    assert all(r.vector is None for r in pages.encoded(rows, "k", "t", broken).collect())

    def client(content, prompt):
        if prompt == "bad":
            raise ValueError("refused")
        return f"{len(content)} {prompt}"

    crops = spark.createDataFrame([("a", b"xyz", "good"), ("b", b"", "bad")], "id string, content binary, prompt string")
    assert sorted(tuple(r) for r in pages.read_tables(crops, "id", client).collect()) == [("a", "3 good", None), ("b", None, "refused")]


def test_keys_are_rotated():
    waits, calls = [], []

    def call(key):
        calls.append(key)
        if key == "refused":
            raise PermissionError
        if len(calls) < 6:
            raise BlockingIOError(200 if len(calls) < 4 else None)
        return key

    assert pages.call_with_keys(call, ["refused", "a", "b"], waits.append) == "b" and waits == [90]
    with pytest.raises(PermissionError):
        pages.call_with_keys(call, ["refused"], waits.append)
    assert [pages.retry_delays(None, i) for i in range(5)] == [8, 20, 45, 45, 45] and pages.retry_delays(0.2, 0) == 1


def test_wrong_verdicts_are_errors(spark):
    df = spark.createDataFrame([("maybe",)], "v string")
    for column in (feedback.verdict(F.col("v")), feedback.reason(F.col("v"))):
        with pytest.raises(Exception, match="maybe|MAYBE"):
            df.select(column).collect()


def test_stream_upsert_keeps_the_last_row(spark, tmp_path):
    table = spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "user_id", "event_type")
    source, out = str(tmp_path / "in"), str(tmp_path / "state")
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        q = jobs.upsert_stream(stream, out, "user_id", "event_id").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    want = feedback.upsert(table.limit(0), table, "user_id", "event_id")
    assert sorted(map(tuple, jobs.Buckets(spark, out, "user_id", "event_id", "event_id long, user_id long, event_type string").current().select("user_id", "event_id").collect())) == sorted(map(tuple, want.select("user_id", "event_id").collect()))


def test_letters_beyond_latin_1_keep_their_base(spark):
    words = {"tiếng Việt": "tieng viet", "ſtraße ŉ": "strasse n", "Ǆ ǰ ẖ": "j h", "Ṩ Ḁ ẞ": "s a ss", "ﬁn ﬅ": "fin st", "İstanbul ıx": "istanbul x", "≠ 1": "= 1", "é Å": "e a", "日本 x": "x", None: ""}
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", T.fold(F.col("w")).alias("f")).collect()
    assert {r.i: r.f for r in rows} == dict(enumerate(words.values()))


def test_unknown_words_of_requests_are_errors(spark):
    df = spark.createDataFrame([("odd",)], "v string")
    for column in (requests.approach(F.col("v")), requests.target(F.col("v"))):
        with pytest.raises(Exception, match="odd"):
            df.select(column).collect()


def test_vector_search_in_blocks(spark):
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (60, 5)).astype(float)  # many equal scores
    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", x[i].tolist()) for i in range(60)] + [(90, "g1", None), (95, "g1", [None, 1.0]), (92, "g1", [1.0]), (98, "g1", [None, 2.0])]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>").repartition(3)
    asked = df.filter("id % 7 = 0").selectExpr("id AS query_id", "v AS query")
    want = set()
    for q, _, v in rows:
        if q % 7 == 0 and q < 90:
            for g in ("g0", "g1", "g2", None):
                own = [(-round(float(np.dot(np.pad(w, (0, 5 - len(w))), v) / ((np.linalg.norm(w) + 1e-9) * (np.linalg.norm(v) + 1e-9))), 6), i) for i, h, w in rows if h == g and i != q and w and None not in w]
                want |= {(q, g, i, n) for n, (s, i) in enumerate(sorted(own)[:4], 1)}
    for block in (1000, 2):
        got = retrieval.vector_search(df, asked, "id", "v", "grp", 4, block).collect()
        assert {(x.query_id, x.grp, x.id, x["rank"]) for x in got} == want
