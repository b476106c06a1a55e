"""Queries on the kept index. Documents of the index are sources, pages the documents of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import page_index
from pagemill.operators.keywords import keyword_rows
from pagemill.plans.registry import fold_sql, loosen_sql, query, read, spread
from pagemill.sources.shared import kept
from pagemill.sources.vectors import Encoder, encoded


def items(spark, d):
    """query_id, term, weight: the words of the benchmark's texts."""
    terms = F.explode(T.tokens(T.fold(F.col("text")))).alias("term")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), terms).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def built(spark, d):
    """A new index of all documents, and its documents."""
    index = page_index.fresh(spark)
    return index, index.documents(index.update(spread(read(spark, d, "documents").select("doc_id", "source", "text")), "source", "doc_id", "text", page_index.page_key(["doc_id", "text"])))


_ITEMS = f"SELECT item_id AS query_id, term, count(*) AS weight FROM (SELECT item_id, unnest(regexp_extract_all({fold_sql('text')}, '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL"


@query(
    f"WITH t AS MATERIALIZED (SELECT doc_id, source, regexp_extract_all({fold_sql('text')}, '[a-z0-9]+') AS ts FROM documents), st AS (SELECT source, count(*) AS n, sum(greatest(len(ts), 1)) AS total FROM t GROUP BY source), q AS ({_ITEMS}), "
    "tf AS (SELECT doc_id, source, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, source, greatest(len(ts), 1) AS dl, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, source, term), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY source, term), "
    "s AS (SELECT query_id, doc_id, source, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n) + 1e-9))) AS b FROM tf JOIN df USING (source, term) JOIN st USING (source) JOIN q USING (term) GROUP BY query_id, doc_id, source) "
    "SELECT query_id, source, doc_id, round(b, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY round(b, 5) DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 8"
)
def index_topk(spark, d):
    index, documents = built(spark, d)
    found, _ = index.top_k(documents, items(spark, d), 8)
    return found.select("query_id", F.col("grp").alias("source"), F.col("page").alias("doc_id"), "score", "rank")



@query(
    f"WITH t AS (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY source) % 3 AS kind FROM documents), u AS (SELECT source, kind, regexp_extract_all({fold_sql('''CASE WHEN kind = 1 THEN text || ' again' ELSE text END''')}, '[a-z0-9]+') AS ts FROM t), "
    "w AS (SELECT source, count(*) AS n, CAST(sum(greatest(len(ts), 1)) AS BIGINT) AS total, any_value(kind) AS kind FROM u GROUP BY source), c AS (SELECT source, count(DISTINCT term) AS terms FROM (SELECT source, unnest(ts) AS term FROM u) GROUP BY source) "
    "SELECT source, CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS BIGINT) AS build, n, total, coalesce(terms, 0) AS terms FROM w LEFT JOIN c USING (source)"
)
def index_builds(spark, d):
    """Three updates: some documents, then all, then all with some of them changed. Each document stands as the
    build that last changed it made it."""
    docs = read(spark, d, "documents")
    kinds = kept(docs.groupBy("source").agg((F.min("doc_id") % 3).alias("kind")), "kinds")
    pages = docs.join(kinds, "source").withColumn("version", F.xxhash64("doc_id", "text"))
    changed = F.col("kind") == 1
    last = pages.withColumn("text", F.when(changed, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))).withColumn("version", F.when(changed, F.xxhash64("version")).otherwise(F.col("version")))
    index = page_index.fresh(spark)
    for rows in (pages.filter("kind = 0"), pages, last):
        now = index.update(rows, "source", "doc_id", "text", F.col("version"))
    found = index.documents(now).join(index.table("documents").select("gid", "build"), "gid")
    terms = index.table("postings").filter("term <> ''").select("gid", "term").distinct().groupBy("gid").agg(F.count("*").alias("terms"))
    return found.join(terms, "gid", "left").select(F.col("grp").alias("source"), "build", "n", "total", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """An encoder without a model file: how often each letter stands in a text."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            out.append([t.count(c) for c in LETTERS])
            if not any(out[-1]):
                raise ValueError("no letter")
        return out

    return encode


LETTER_ENCODER = Encoder("letters", letter_counts)


def letters_sql(x: str) -> str:
    """The list of letter counts of a text."""
    return "[" + ", ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in LETTERS) + "]"


@query(
    f"WITH t AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 41 = 0 THEN '#' ELSE text END, '') AS x FROM documents), v AS (SELECT doc_id, {letters_sql('x')} AS v FROM t), s AS (SELECT *, list_sum(v) AS size FROM v) "
    "SELECT doc_id, CASE WHEN size > 0 THEN CAST(v[1] AS DOUBLE) END AS a, CASE WHEN size > 0 THEN CAST(v[26] AS DOUBLE) END AS z, CASE WHEN size = 0 THEN 'ValueError: no letter' END AS error FROM s"
)
def encoded_pages(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 41 == 0, "#").otherwise(F.col("text")).alias("text"))
    out = encoded(rows, "text", LETTER_ENCODER)
    return out.select("doc_id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[25].cast("double").alias("z"), "error")


@query(
    f"WITH d AS MATERIALIZED (SELECT doc_id, {fold_sql('text')} AS f FROM documents), e AS MATERIALIZED (SELECT *, {loosen_sql('f')} AS l FROM d), "
    f"b AS (SELECT item_id, regexp_extract_all({fold_sql('text')}, '[a-z0-9]+') AS ws FROM benchmark), w AS (SELECT 'pair' AS kind, CAST(item_id AS VARCHAR) AS name, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ', ' || ws[i + 1])) AS k FROM b UNION ALL SELECT 'order', o_orderstatus, CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'part', p_brand, lower(p_name) FROM part), "
    "u AS MATERIALIZED (SELECT DISTINCT k, CASE WHEN contains(k, ' ') THEN trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) END AS wide FROM w), m AS (SELECT doc_id, k FROM u JOIN e ON contains(f, k) OR (wide IS NOT NULL AND contains(l, wide))) "
    "SELECT doc_id, kind, name, CAST(count(*) AS INT) AS hits FROM m JOIN w USING (k) GROUP BY ALL"
)
def keyword_join(spark, d):
    """Word pairs of the benchmark, order numbers and part names, looked for in all documents."""
    ws = T.tokens(T.fold(F.col("text")))
    pairs = read(spark, d, "benchmark").select(F.lit("pair").alias("kind"), F.col("item_id").cast("string").alias("name"), F.explode(F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(", "), b))).alias("keyword"))
    orders = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").cast("string").alias("keyword"))
    parts = read(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_brand").alias("name"), F.lower("p_name").alias("keyword"))
    docs = T.with_folded(spread(read(spark, d, "documents").select("doc_id", "text")))
    return keyword_rows(docs, pairs.unionAll(orders).unionAll(parts), ["doc_id"])
