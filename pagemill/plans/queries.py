"""The engine's queries over the standard tables, and the SQL that must give the same rows.

Documents stand for pages: source is the document and doc_id the page. The vocabulary is that of the
tables' invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import classify, feedback, geometry, retrieval, tables
from pagemill.operators.keys import join_groups
from pagemill.plans.registry import ORACLES, QUERIES, fold_sql, hits_sql, loose_sql, query, quote, read, spread  # noqa: F401
from pagemill.streaming import jobs

SCOPES = {"consolidated": ["the", "and the"], "statutory": ["der", "die "], "mixed": ["le ", "de la"]}
SECTORS = {"bank": ["tion", "onan", "reeux"], "insurance": ["heit", "keit", "ver"], "other": ["cion", "ment", "ando"]}
TITLES = {"assets": ["of the"], "equity": ["und der"], "income": ["de la"]}
ANCHORS = {"assets": ["ing", "tion", "ing"], "equity": ["ung", "keit"], "income": ["ment", "eaux"]}
KEYWORDS = ["the", "of the", "and, the", "tion", "der die", "le"]
QUERY = "the of and thonan tion the"
def folded(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Documents with folded and loosened text, each worked out once."""
    return T.with_folded(spread(read(spark, d, "documents").select("doc_id", "text", *keep))).drop("text")


def folds():
    return F.col("folded"), F.col("loosened")


FOLDED = f"WITH d AS (SELECT doc_id, source, lang, text, {fold_sql('text')} AS f, {loose_sql('text')} AS l FROM documents)"


@query(f"{FOLDED} SELECT doc_id, f AS folded FROM d")
def fold_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"{FOLDED} SELECT doc_id, CAST(len(regexp_extract_all(f, '[a-z0-9]+')) AS BIGINT) AS n_tokens, md5(array_to_string(regexp_extract_all(f, '[a-z0-9]+'), ' ')) AS token_md5 FROM d")
def tokenize(spark, d):
    rows = read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("f")).select("doc_id", T.tokens(F.col("f")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_md5"))


@query(f"SELECT doc_id, coalesce(nullif(trim(regexp_replace({fold_sql('text')}, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'document') AS slug FROM documents")
def slugify(spark, d):
    return read(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"{FOLDED} SELECT doc_id, l AS loose FROM d")
def loose_phrase(spark, d):
    return read(spark, d, "documents").select("doc_id", T.loose(F.col("text")).alias("loose"))


@query(f"{FOLDED} SELECT doc_id, array_to_string({hits_sql(KEYWORDS)}, '|') AS hits, CAST(len({hits_sql(KEYWORDS)}) AS BIGINT) AS n_hits FROM d")
def keyword_hits(spark, d):
    rows = folded(spark, d).select("doc_id", T.keyword_hits(*folds(), KEYWORDS).alias("h"))
    return rows.select("doc_id", F.array_join("h", "|").alias("hits"), F.size("h").cast("long").alias("n_hits"))


@query(f"{FOLDED} SELECT doc_id, " + " + ".join(f"CAST(contains(left(f, 900), '{w}') AS INT)" for w in ("the", "of", "der", "tion", "que")) + " >= 3 AS is_match FROM d")
def marker_k_of_n_window(spark, d):
    rows = folded(spark, d).select("doc_id", F.substring("folded", 1, 900).alias("head"))
    return rows.select("doc_id", (T.count_markers(F.col("head"), ["the", "of", "der", "tion", "que"]) >= 3).alias("is_match"))


_SCOPE_ROWS = ", ".join(f"struct_pack(n := len({hits_sql(w)}), name := '{k}')" for k, w in SCOPES.items())


@query(
    f"{FOLDED}, o AS (SELECT doc_id, source, list_transform(list_reverse_sort(list_filter([{_SCOPE_ROWS}], lambda x: x.n > 0)), lambda x: x.name) AS own FROM d), "
    "p AS (SELECT doc_id, own, last_value(own[1] IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS top FROM o) "
    "SELECT doc_id, CASE WHEN len(own) > 0 THEN array_to_string(own, ',') ELSE coalesce(top, '') END AS scopes FROM p"
)
def scope_forward_fill(spark, d):
    out = classify.scope_ranges(read(spark, d, "documents"), "source", "doc_id", "text", SCOPES)
    return out.select("doc_id", F.array_join("scopes", ",").alias("scopes"))


@query(
    f"{FOLDED}, s AS (SELECT source, "
    + ", ".join(" + ".join(f"CAST(bool_or(contains(f, '{w}')) AS INT)" for w in words) + f" AS n_{k}" for k, words in SECTORS.items())
    + " FROM d GROUP BY source) SELECT source, CASE WHEN n_bank >= n_insurance AND n_bank >= n_other THEN 'bank' WHEN n_insurance >= n_other THEN 'insurance' ELSE 'other' END AS sector, CAST(greatest(n_bank, n_insurance, n_other) AS INT) AS n_hits FROM s"
)
def sector_argmax(spark, d):
    return classify.sector(read(spark, d, "documents"), "source", "text", SECTORS)


@query(
    f"{FOLDED}, h AS (SELECT doc_id, len({hits_sql(SECTORS['bank'])}) AS b, len({hits_sql(SECTORS['insurance'])}) AS i FROM d) "
    "SELECT doc_id, CASE WHEN i >= 2 AND i > b THEN 'insurance' WHEN b >= 2 AND b > i THEN 'bank' ELSE 'other' END AS sector FROM h"
)
def sector_correction(spark, d):
    rows = folded(spark, d).select("doc_id", *(F.size(T.keyword_hits(*folds(), SECTORS[k])).alias(k) for k in ("bank", "insurance")))
    return rows.select("doc_id", classify.corrected_sector(F.lit("other"), {k: F.col(k) for k in ("bank", "insurance")}, 2).alias("sector"))


@query(
    f"{FOLDED} SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN len({hits_sql(TITLES[k])}) > 0 OR len({hits_sql(ANCHORS[k])}) >= 2 THEN '{k}' END" for k in TITLES)
    + "], lambda x: x IS NOT NULL), ',') AS targets FROM d"
)
def target_candidates(spark, d):
    return folded(spark, d).select("doc_id", F.array_join(classify.target_candidates(*folds(), TITLES, ANCHORS), ",").alias("targets"))


@query(f"{FOLDED} SELECT doc_id, array_to_string(list_sort(list_distinct({hits_sql([w for x in ANCHORS.values() for w in x])})), ',') AS anchors FROM d")
def distinct_anchors(spark, d):
    return folded(spark, d).select("doc_id", F.array_join(classify.distinct_anchors(*folds(), ANCHORS), ",").alias("anchors"))


def _bm25_sql(queries: str) -> str:
    return (
        f"{FOLDED}, t AS (SELECT doc_id, source, regexp_extract_all(f, '[a-z0-9]+') AS ts FROM d), st AS (SELECT source, count(*) AS n, sum(greatest(len(ts), 1)) AS total FROM t GROUP BY source), "
        f"q AS ({queries}), e AS (SELECT doc_id, source, greatest(len(ts), 1) AS dl, unnest(ts) AS term FROM t), "
        "tf AS (SELECT doc_id, source, term, any_value(dl) AS dl, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY doc_id, source, term), "
        "df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY source, term), "
        "s AS (SELECT query_id, doc_id, source, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (total / n) + 1e-9))) AS bm25 FROM tf JOIN df USING (source, term) JOIN st USING (source) JOIN q USING (term) GROUP BY query_id, doc_id, source)"
    )


_ONE_QUERY = "SELECT 0 AS query_id, unnest(['" + "', '".join(dict.fromkeys(QUERY.split())) + "']) AS term, unnest([" + ", ".join(str(QUERY.split().count(t)) for t in dict.fromkeys(QUERY.split())) + "]) AS weight"


def _one_query(spark: SparkSession) -> DataFrame:
    words = QUERY.split()
    return spark.createDataFrame([(0, t, words.count(t)) for t in dict.fromkeys(words)], "query_id long, term string, weight int")


@query(
    _bm25_sql(_ONE_QUERY) + ", a AS (SELECT d.source, d.doc_id, coalesce(bm25, 0.0) AS b FROM d LEFT JOIN s USING (source, doc_id)), "
    "m AS (SELECT source, doc_id, CASE WHEN max(b) OVER w - min(b) OVER w < 1e-12 THEN 0.0 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END AS x FROM a WINDOW w AS (PARTITION BY source)), "
    "r AS (SELECT source, doc_id, round(x, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(x, 6) DESC, doc_id) AS rank FROM m) SELECT source, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"
)
def bm25_topk(spark, d):
    docs = spread(read(spark, d, "documents").select("doc_id", "source", "text"))
    scores = retrieval.bm25(docs, "doc_id", "source", "text", _one_query(spark))
    every = join_groups(read(spark, d, "documents").select("source", "doc_id"), scores.drop("query_id"), ["source", "doc_id"], "left").fillna(0.0, ["bm25"])
    scaled = retrieval.minmax(every, ["source"], "bm25").select("source", "doc_id", F.round("bm25", 6).alias("score"))
    return retrieval.top_k(scaled, ["source"], "score", ["doc_id"], 8)


_ITEM_TERMS = f"SELECT item_id AS query_id, term, count(*) AS weight FROM (SELECT item_id, unnest(regexp_extract_all({fold_sql('text')}, '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL"


@query(
    _bm25_sql(_ITEM_TERMS) + ", r AS (SELECT query_id, source, doc_id, round(bm25, 5) AS score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(bm25, 5) DESC, doc_id) AS rank FROM s) SELECT query_id, source, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"
)
def bm25_multi_query(spark, d):
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(T.fold(F.col("text")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    return retrieval.bm25_best(spread(read(spark, d, "documents").select("doc_id", "source", "text")), "doc_id", "source", "text", items, 3)


_COS = (
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), "
    "q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0), c AS (SELECT query_id, vec_id, label, list_dot_product(e, qe) / ((sqrt(list_dot_product(e, e)) + 1e-9) * (sqrt(list_dot_product(qe, qe)) + 1e-9)) AS c FROM v, q)"
)


@query(
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), "
    "c AS (SELECT q.vec_id AS query_id, v.label, v.vec_id, round(list_dot_product(v.e, q.e) / ((sqrt(list_dot_product(v.e, v.e)) + 1e-9) * (sqrt(list_dot_product(q.e, q.e)) + 1e-9)), 6) AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) "
    "SELECT query_id, label, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS INT) AS rank FROM c QUALIFY rank <= 8"
)
def cosine_topk(spark, d):
    v = read(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(v, asked, "vec_id", "embedding", "label", 8)


_BLEND = (
    f"{FOLDED}, "
    + _COS.removeprefix("WITH ")
    + f", b AS (SELECT q.query_id, doc_id, source, len({hits_sql(KEYWORDS)}) / {len(KEYWORDS)}.0 AS lex, c FROM d JOIN q ON true LEFT JOIN c ON vec_id = doc_id AND c.query_id = q.query_id), "
    "n AS (SELECT query_id, source, min(c) AS lo, max(c) AS hi FROM b GROUP BY query_id, source), "
    "x AS (SELECT query_id, doc_id, source, round(0.6 * lex + 0.4 * CASE WHEN c IS NULL OR hi - lo < 1e-12 THEN 0.0 ELSE (c - lo) / (hi - lo) END, 6) AS score, lex FROM b JOIN n USING (query_id, source)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM x)"
)


def _blended(spark, d) -> DataFrame:
    """What may be among the 8 best documents of a source for a request, a vector whose id is divisible by 50."""
    docs = folded(spark, d, "source").select("doc_id", "source", (F.size(T.keyword_hits(*folds(), KEYWORDS)) / F.lit(float(len(KEYWORDS)))).alias("lex"))
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.blended(docs, vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")), 8)


@query(f"{_BLEND} SELECT query_id, source, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")
def hybrid_blend(spark, d):
    return retrieval.top_k(_blended(spark, d), ["query_id", "source"], "score", ["doc_id"], 8).select("query_id", "source", "doc_id", "score", "rank")


@query(
    f"{_BLEND}, h AS (SELECT *, coalesce(max(score) FILTER (WHERE rank = 1) OVER w - max(score) FILTER (WHERE rank = 2) OVER w < 0.045, false) AND rank <= 6 AS near FROM r WHERE rank <= 8 WINDOW w AS (PARTITION BY query_id, source)), "
    "z AS (SELECT query_id, source, doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY CASE WHEN rank <= 6 THEN 0 ELSE 1 END, CASE WHEN near THEN lex END DESC NULLS LAST, CASE WHEN near THEN doc_id END NULLS FIRST, rank) AS rank FROM h) SELECT query_id, source, doc_id, score, CAST(rank AS INT) AS rank FROM z"
)
def tiebreak_rerank(spark, d):
    best = retrieval.top_k(_blended(spark, d), ["query_id", "source"], "score", ["doc_id"], 8)
    return retrieval.tiebreak(best, ["query_id", "source"], "score", [F.col("lex")], "doc_id").select("query_id", "source", "doc_id", "score", "rank")


_ALL = [w for x in SECTORS.values() for w in x]
_GROUPS = [["tion", "ment"], ["heit", "keit"]]


@query(
    f"{FOLDED}, h AS (SELECT doc_id, list_distinct({hits_sql(_ALL)}) AS h FROM d), g AS (SELECT doc_id, len(h) AS n, "
    + " + ".join("CAST(" + " OR ".join(f"len(list_filter(h, lambda x: contains(x, '{w}'))) > 0" for w in g) + " AS INT)" for g in _GROUPS)
    + f" AS found FROM h), b AS (SELECT doc_id, n, 0.75 * (0.25 * least(n / 18.0, 1.0) + 0.75 * (n / {len(_ALL)}.0)) + 0.25 * found / 2 AS b FROM g) SELECT doc_id, round(least(greatest(CASE WHEN n <= 3 THEN b * 0.35 WHEN n <= 6 THEN b * 0.7 ELSE b END, 0), 1), 6) AS coverage FROM b"
)
def signature_coverage(spark, d):
    rows = folded(spark, d).select("doc_id", F.array_distinct(T.keyword_hits(*folds(), _ALL)).alias("h"))
    return rows.select("doc_id", F.round(retrieval.coverage(F.col("h"), len(_ALL), _GROUPS, 18), 6).alias("coverage"))


@query(
    f"{FOLDED}, a AS (SELECT doc_id, f, least(length(text) / CAST(4000 AS DOUBLE), 1.0) AS s FROM d), b AS (SELECT doc_id, f, CASE WHEN contains(f, 'tion') THEN s * 0.45 ELSE s END AS s FROM a), "
    "c AS (SELECT doc_id, f, CASE WHEN contains(f, 'of the') THEN least(s + 0.18, 1.0) ELSE s END AS s FROM b), e AS (SELECT doc_id, f, CASE WHEN contains(f, 'keit') THEN greatest(s, 0.8) ELSE s END AS s FROM c) "
    "SELECT doc_id, round(CASE WHEN contains(f, '%') THEN least(s, 0.5) ELSE s END, 9) AS score FROM e"
)
def rule_fold(spark, d):
    f = F.col("f")
    has = lambda w: F.contains(f, F.lit(w))
    rules = [(has("tion"), "mul", 0.45), (has("of the"), "boost", 0.18), (has("keit"), "floor", 0.8), (has("%"), "cap", 0.5)]
    docs = read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("f"), F.least(F.length("text") / 4000.0, F.lit(1.0)).alias("s"))
    return docs.select("doc_id", F.round(retrieval.fold_rules(F.col("s"), rules), 9).alias("score"))


@query(
    f"{FOLDED}, k AS (SELECT doc_id, source, contains(f, 'tion') AS a, contains(f, 'ment') AS b FROM d), n AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, false) OR coalesce(lead(b) OVER w, false) AS near FROM k WINDOW w AS (PARTITION BY source ORDER BY doc_id)) "
    "SELECT doc_id, CAST(CASE WHEN a AND b THEN 0.95 WHEN a AND near THEN 0.85 ELSE 0.0 END AS DOUBLE) AS layout FROM n"
)
def neighbor_layout(spark, d):
    f = F.col("folded")
    pages = folded(spark, d, "source").select("doc_id", "source", F.contains(f, F.lit("tion")).alias("a"), F.contains(f, F.lit("ment")).alias("b"))
    return retrieval.neighbours(pages, "source", "doc_id", F.col("a"), F.col("b")).select("doc_id", "layout")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, n_chars > 20000 AS k, bool_or(n_chars > 20000) OVER (PARTITION BY source, lang) AS any_kept FROM documents) WHERE k OR NOT any_kept")
def exclude_then_fallback(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return retrieval.keep_or_all(docs, ["source", "lang"], F.col("n_chars") > 20000).select("doc_id", "source")


@query(
    "WITH e AS (SELECT user_id, event_type, epoch(ts) AS y0, epoch(ts) + 60 AS y1 FROM events), n AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w > 86400 AND count(*) OVER (PARTITION BY user_id) > 2 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY y0, y1, event_type)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY y0, y1, event_type ROWS UNBOUNDED PRECEDING) AS run FROM n), "
    "s AS (SELECT user_id, run, count(DISTINCT event_type) AS n_labels, count(*) AS n_lines, min(y0) AS y0, max(y1) AS y1 FROM r GROUP BY user_id, run) "
    "SELECT user_id, n_labels, n_lines, y0, y1 FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n_labels DESC, n_lines DESC, run) = 1"
)
def dense_cluster(spark, d):
    y0 = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    lines = read(spark, d, "events").select("user_id", "event_type", y0.alias("y0"), (y0 + 60).alias("y1"))
    return geometry.densest_cluster(lines, ["user_id"], "y0", "y1", "event_type", 86400)


@query(
    "WITH a AS (SELECT l_orderkey, l_linenumber AS k, l_extendedprice AS y FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey, l_linenumber AS k, l_extendedprice AS y FROM lineitem WHERE l_returnflag = 'R') "
    "SELECT l_orderkey, abs(a.y - b.y) AS dy, a.k AS left_key, b.k AS right_key FROM a JOIN b USING (l_orderkey) WHERE abs(a.y - b.y) <= 4000 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(a.y - b.y), a.k, b.k) = 1"
)
def nearest_pair(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("y"), "l_returnflag")
    return geometry.nearest_pair(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), ["l_orderkey"], "y", "k", 4000.0)


@query(
    "WITH f AS (SELECT l_orderkey, min(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_extendedprice > 1008) AS first_boundary FROM lineitem GROUP BY l_orderkey), "
    "g AS (SELECT l_orderkey, first_boundary, max(l_extendedprice + l_quantity) FILTER (WHERE l_returnflag = 'A' AND coalesce(l_extendedprice + l_quantity < first_boundary, true)) AS end_anchor FROM lineitem JOIN f USING (l_orderkey) GROUP BY ALL) "
    "SELECT l_orderkey, first_boundary, end_anchor, coalesce(end_anchor + 4, first_boundary - 2) AS y_end FROM g"
)
def boundary_and_anchor(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("y1"), "l_returnflag")
    return geometry.bounds_below(rows, ["l_orderkey"], "y0", "y1", F.lit(1000.0), F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")


@query(
    "WITH b AS (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity * 20 - 100, 0), 600.0) AS a, least(greatest(l_extendedprice / 50, 0), 800.0) AS b, least(greatest(l_discount * 9000, 0), 600.0) AS c, least(greatest(l_tax * 9000 - 50, 0), 800.0) AS d FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM b"
)
def clamp_boxes(spark, d):
    box = geometry.clamp_box(F.col("l_quantity") * 20 - 100, F.col("l_extendedprice") / 50, F.col("l_discount") * 9000, F.col("l_tax") * 9000 - 50, F.lit(600.0), F.lit(800.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber, round(greatest(0.5 * l_discount * 10 + 0.25 * l_tax * 10 + 0.1 * 1.0 + 0.12 * l_quantity / 50 + 0.03 * 0.5 + CASE WHEN l_returnflag = 'R' THEN -0.16 ELSE 0.0 END, 0), 6) AS score FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, score FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) = 1"
)
def candidate_rank(spark, d):
    s = geometry.candidate_rank(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(1.0), F.col("l_quantity") / 50, F.lit(0.5), F.when(F.col("l_returnflag") == "R", -0.16).otherwise(0.0))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))
    return retrieval.top_k(rows, ["l_orderkey"], "score", ["l_linenumber"], 1).drop("rank")


_LABEL = "CASE p_partkey % 5 WHEN 0 THEN 'Résultat  net de ' || p_name WHEN 1 THEN 'Total ' || p_name WHEN 2 THEN p_name || ' sous-total' ELSE p_name END"


@query(f"WITH l AS (SELECT *, {fold_sql(_LABEL)} AS f FROM part) SELECT p_partkey, CASE WHEN contains(f, 'resultat net') THEN 'result' WHEN starts_with(f, 'total') OR regexp_matches(f, '\\btotal\\b') THEN 'total' WHEN p_size % 7 = 0 THEN 'section_header' ELSE 'data' END AS row_type FROM l")
def row_typing(spark, d):
    values = F.array(F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.col("p_brand")), F.lit(None).cast("string"))
    return read(spark, d, "part").select("p_partkey", tables.row_type(F.expr(_LABEL), values).alias("row_type"))


@query(
    "WITH o AS (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(avg(l_discount) * 10, 0) AS conf, coalesce(bool_or(l_returnflag = 'R'), false) AS off FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), "
    "i AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 13 = 0 THEN 'missing_columns' END, CASE WHEN n = 0 THEN 'missing_rows' END, CASE WHEN n < 3 THEN 'too_few_rows' END) AS issues, concat_ws(',', CASE WHEN off THEN 'extracted_rows_mention_off_balance_verify_crop' END, CASE WHEN round(conf, 6) < 0.45 THEN 'low_vision_confidence' END) AS warnings FROM o) "
    "SELECT o_orderkey, CASE WHEN issues <> '' THEN 'rejected' WHEN warnings <> '' THEN 'warning' ELSE 'approved' END AS status, issues, warnings FROM i"
)
def table_validate(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), (F.avg("l_discount") * 10).alias("conf"), F.max(F.col("l_returnflag") == "R").alias("off"))
    rows = read(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    columns = F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(3)
    v = tables.validate(columns, F.coalesce("n", F.lit(0)), F.round(F.coalesce("conf", F.lit(0.0)), 6), F.coalesce("off", F.lit(False)))
    return rows.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


@query("SELECT p_partkey, '| ' || concat_ws(' | ', trim(replace(replace(p_name || '|x', '|', '\\|'), chr(10), ' ')), p_brand, CAST(p_size AS VARCHAR)) || ' |' AS line FROM part")
def to_markdown(spark, d):
    cells = [F.concat("p_name", F.lit("|x")), F.col("p_brand"), F.col("p_size").cast("string")]
    return read(spark, d, "part").select("p_partkey", tables.markdown_row(cells).alias("line"))


@query(
    f"SELECT conv_id, turn, concat_ws(' | ', 'conversation: ' || conv_id, 'turn: ' || turn, 'type: ' || nullif(role, ''), 'length: ' || length(text)) AS chunk, replace({fold_sql("concat_ws('_', CAST(conv_id AS VARCHAR), role, substr(text, 1, 48))")}, ' ', '_') AS chunk_id FROM conversations"
)
def evidence_chunks(spark, d):
    c = read(spark, d, "conversations")
    body = tables.chunk_text({"conversation": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")}, F.col("role"), {"length": F.length("text").cast("string")})
    return c.select("conv_id", "turn", body.alias("chunk"), tables.chunk_id([F.col("conv_id").cast("string"), F.col("role")], F.col("text")).alias("chunk_id"))


@query(f"{FOLDED} SELECT doc_id, CASE WHEN contains(f, 'tion') THEN substr(text, CAST(greatest(strpos(f, 'tion') - 40, 1) AS BIGINT), CAST(strpos(f, 'tion') - greatest(strpos(f, 'tion') - 40, 1) + 44 AS BIGINT)) ELSE substr(text, 1, 80) END AS excerpt FROM d")
def excerpt_around(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", T.fold(F.col("text")).alias("f"))
    return rows.select("doc_id", T.excerpt(F.col("text"), F.col("f"), F.lit("tion"), 40).alias("excerpt"))


_UPSERT = "WITH s AS (SELECT doc_id, quality, toxic, 0 AS v FROM labels), f AS (SELECT doc_id, 1 AS quality, 0 AS toxic, 1 AS v FROM documents WHERE lang = 'fr')"


@query(f"{_UPSERT} SELECT doc_id, quality, toxic FROM (SELECT * FROM s UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) = 1")
def feedback_upsert(spark, d):
    stored = read(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(0).alias("v"))
    fresh = read(spark, d, "documents").filter("lang = 'fr'").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), F.lit(1).alias("v"))
    return feedback.upsert(stored, fresh, "doc_id", "v").select("doc_id", "quality", "toxic")


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality <> 1) AS failed, round(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY source")
def feedback_report(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return feedback.report(rows, ["source"], F.col("quality") == 1)


@query("SELECT source, lang, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source, lang)")
def accuracy_by_group(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.rollup("source", "lang").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("passed"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_latest_state(spark, d):
    return feedback.latest(read(spark, d, "events"), "user_id", "ts", "event_id", ["event_type"]).select("user_id", "event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def job_window_counts(spark, d):
    return jobs.counts(read(spark, d, "events"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE event_type IN ('purchase', 'error') GROUP BY event_type")
def job_terminal_counts(spark, d):
    ends = read(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    return ends.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def complete_pairs_anti(spark, d):
    missing = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(missing, "o_orderkey", "left_anti")


@query(
    "WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || upper(p_name) || ' x X', ' ') AS ws FROM part) "
    "SELECT p_partkey, array_to_string(list_filter(ws, lambda w, i: w <> '' AND list_position(list_transform(ws, lambda x: lower(x)), lower(w)) = i), ' ') AS words FROM w"
)
def dedupe_ordered(spark, d):
    words = F.split(F.concat("p_name", F.lit(" "), F.upper("p_name"), F.lit(" x X")), " ")
    return read(spark, d, "part").select("p_partkey", F.array_join(T.dedupe(words), " ").alias("words"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{\"a\": ' || props || ', \"b\": \"}{\\\"\"}' END AS object FROM events")
def first_json_object(spark, d):
    body = F.concat(F.lit('```json\n{"a": '), "props", F.lit(', "b": "}{\\""}\n``` and } {'))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("{ open")).otherwise(body)
    return read(spark, d, "events").select("event_id", T.first_object(text).alias("object"))


_RULES = {"narrative": (2600, 2, ["the", "of", "que"]), "note": (3200, 3, ["tion", "ment", "keit", "der"]), "anywhere": (None, 1, ["ando"])}


@query(
    f"{FOLDED} SELECT doc_id, array_to_string(list_filter(["
    + ", ".join("CASE WHEN " + " + ".join(f"CAST(contains({f'left(f, {w})' if w else 'f'}, '{m}') AS INT)" for m in ms) + f" >= {n} THEN '{k}' END" for k, (w, n, ms) in _RULES.items())
    + "], lambda x: x IS NOT NULL), ',') AS rules FROM d"
)
def marker_rules(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("f"))
    return docs.select("doc_id", F.array_join(classify.matched_rules(F.col("f"), _RULES), ",").alias("rules"))


@query("SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'now' WHEN '2-high' THEN 'now' WHEN '5-low' THEN 'later' ELSE 'some day' END AS due FROM orders")
def canonical_alias(spark, d):
    due = classify.canonical(F.col("o_orderpriority"), {"now": ["1-urgent", "2-high"], "later": ["5-low"]}, "some day")
    return read(spark, d, "orders").select("o_orderkey", due.alias("due"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS label, 'brand,none' AS columns, p_brand || ',' AS cells FROM part")
def normalize_table(spark, d):
    columns = F.array(*map(F.lit, ("Label", "brand", "Name", "none")))
    values = F.map_from_arrays(F.array(*map(F.lit, ("Label", "Name", "brand"))), F.array(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.lit(" ")), F.col("p_name"), F.col("p_brand")))
    row = tables.normalized_row(columns, values, ["label", "name"]).alias("r")
    return read(spark, d, "part").select("p_partkey", row).select("p_partkey", F.col("r.label").alias("label"), F.array_join("r.columns", ",").alias("columns"), F.array_join("r.values", ",").alias("cells"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 15 THEN greatest(floor(p_size * 0.35), 4) ELSE greatest(floor(p_size * 0.25), 7) END AS BIGINT) AS n_balance, CAST(CASE WHEN p_size <= 15 THEN greatest(floor(p_size * 0.35), 4) ELSE greatest(floor(p_size * 0.22), 8) END AS BIGINT) AS n_income FROM part")
def region_min_hits(spark, d):
    n = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", geometry.least_hits(n, False).cast("long").alias("n_balance"), geometry.least_hits(n, True).cast("long").alias("n_income"))


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(rank AS INT) AS rank FROM r "
    "WHERE rank <= 2 OR CASE WHEN l_returnflag = 'R' THEN l_quantity / 50 >= 0.30 OR (l_quantity / 50 >= 0.18 AND l_discount * 10 >= 0.25) ELSE l_quantity / 50 >= 0.45 END"
)
def widen_candidates(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    ranked = retrieval.top_k(rows, ["l_orderkey"], "l_extendedprice", ["l_linenumber"], 1 << 30)
    wide = retrieval.widened(ranked, 2, F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_returnflag") == "R")
    return wide.select("l_orderkey", "l_linenumber", "rank")


from pagemill.plans import index, layouts, names, records, selection, statements  # noqa: E402, F401 - these register their queries
