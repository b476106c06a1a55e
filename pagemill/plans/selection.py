"""The whole way from requests to tables, on the scored pages of statements and the layouts of the same documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import scoring, selection
from pagemill.plans import layouts, statements
from pagemill.plans.registry import query
from pagemill.sources.shared import kept

_RANKED = statements.RETRIEVED_SQL.format(columns="query_id, source, doc_id, target, rk AS rank, score, scope_score, sig, anchor_score")
_LOOKED = "rank <= 4 OR CASE WHEN target = 'income' THEN sig >= 0.30 OR (sig >= 0.18 AND anchor_score >= 0.25) ELSE sig >= 0.45 END"
_FOUND = " UNION ALL ".join(f"SELECT rp.*, way, titled, x0, y0, x1, y1, {layouts.confidence_sql(t, 'score', 'scope_score')} AS confidence FROM rp JOIN ({layouts.localize_sql(t)}) l USING (doc_id) WHERE target = '{t}' AND way <> 'none'" for t in scoring.TARGETS)


@query(
    f"WITH ra AS MATERIALIZED ({_RANKED}), rp AS (SELECT * FROM ra WHERE {_LOOKED}), fo AS MATERIALIZED ({_FOUND}), "
    "sc AS (SELECT *, greatest(0.5 * score + 0.25 * confidence + 0.1 * scope_score + 0.12 * sig + 0.03 * anchor_score + CASE WHEN target = 'income' THEN CASE WHEN sig >= 0.35 THEN 0.08 ELSE 0 END - CASE WHEN way = 'page' AND sig < 0.1 AND anchor_score < 0.1 THEN 0.16 ELSE 0 END - CASE WHEN way = 'blocks' AND NOT titled AND sig < 0.15 THEN 0.1 ELSE 0 END ELSE 0 END, 0) AS rs FROM fo), "
    "ca AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(rs, 9) DESC, doc_id) AS rn, count(*) OVER (PARTITION BY query_id, source) AS n FROM sc), g AS (SELECT DISTINCT query_id, source FROM ra) "
    "SELECT g.query_id, g.source, c.doc_id, c.way, round(c.x0, 3) AS x0, round(c.y0, 3) AS y0, round(c.x1, 3) AS x1, round(c.y1, 3) AS y1, round(c.confidence, 5) AS confidence, round(c.rs, 5) AS rank_score, coalesce(c.n, 0) AS n_candidates, "
    "CASE WHEN c.target = 'income' AND EXISTS (SELECT 1 FROM ca o WHERE o.query_id = c.query_id AND o.source = c.source AND o.doc_id = c.doc_id + 1) THEN c.doc_id + 1 END AS next_page, CASE WHEN c.n IS NULL THEN 'no_table_candidate_found' END AS warning "
    "FROM g LEFT JOIN ca c ON c.query_id = g.query_id AND c.source = g.source AND c.rn = 1"
)
def selected_tables(spark, d):
    group = ["query_id", "source"]
    best = kept(scoring.retrieved(statements.full_scores(spark, d), group, "doc_id").select(*group, "doc_id", "target", "rank", "score", "scope_score", "sig", "anchor_score"), "retrieved")
    pages = layouts.pages(spark, d).withColumn("page", F.col("doc_id")).withColumnRenamed("doc_id", "document")
    found = kept(selection.table_candidates(best.withColumn("document", F.col("doc_id")).withColumnRenamed("doc_id", "page"), pages, group, "document", "page", layouts.LABELS), "candidates")
    rows = selection.selected(best, found, group, "page")
    numbers = {"x0": "table.x0", "y0": "table.y0", "x1": "table.x1", "y1": "table.y1"}
    return rows.select(*group, F.col("page").alias("doc_id"), "way", *(F.round(c, 3).alias(n) for n, c in numbers.items()), F.round("confidence", 5).alias("confidence"), F.round("rank_score", 5).alias("rank_score"), "n_candidates", "next_page", "warning")
