"""From scored pages to one table for each request: which pages are looked at, what is found on them, and which
of it is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import geometry, layout, retrieval
from pagemill.operators.keys import join_groups

#: Pages of a request that are looked at in any case.
PAGES = 4


def table_candidates(retrieved: DataFrame, layouts: DataFrame, group: list[str], document: str, page: str, labels: dict[str, list[str]], words: layout.Words = layout.WORDS) -> DataFrame:
    """A row for each table that is found on a page looked at: group, document, page, target, way, titled, table,
    confidence, score, scope_score, sig, anchor_score, rank_score and rank in its group. retrieved: ranked pages of
    scoring.retrieved(); layouts: document, page, lines, blocks, width, height. Pages meet their layout once, whatever
    the number of targets, and only pages that are looked at do."""
    looked = retrieval.widened(retrieved, PAGES, F.col("sig"), F.col("anchor_score"), F.col("target") == "income")
    keep = [*dict.fromkeys([*group, document, page]), "target", "score", "scope_score", "sig", "anchor_score"]
    rows = join_groups(looked.select(*keep), layouts, [document, page])
    found = None
    for target, own in labels.items():
        here = layout.localized(rows.filter(F.col("target") == target), target, own, words).filter("way <> 'none'").select(*keep, "way", "titled", "table", "confidence")
        found = here if found is None else found.unionByName(here)
    income = F.col("target") == "income"
    penalty = F.when(income, geometry.income_penalty(F.col("sig"), F.col("anchor_score"), F.col("way") == "page", F.col("titled"))).otherwise(0.0)
    ranked = found.withColumn("rank_score", geometry.candidate_rank(F.col("score"), F.col("confidence"), F.col("scope_score"), F.col("sig"), F.col("anchor_score"), penalty))
    # A few rows of each group.
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.round("rank_score", 9)), page)))


def selected(requests: DataFrame, candidates: DataFrame, group: list[str], page: str) -> DataFrame:
    """A row for each request (a row of `group`): its first candidate, how many there were, and the next page where an
    income statement goes on (the page after, if it has a candidate too); a request without any has a warning."""
    first = candidates.filter("rank = 1")
    counts = candidates.groupBy(*group).agg(F.count("*").alias("n_candidates"))
    pages = candidates.select(*group, F.col(page).alias("_next")).distinct().withColumn("_on", F.lit(True))
    own = join_groups(first.withColumn("_next", F.col(page) + 1), pages, [*group, "_next"], "left")
    own = own.withColumn("next_page", F.when((F.col("target") == "income") & F.col("_on"), F.col("_next"))).drop("_next", "_on", "rank")
    rows = join_groups(join_groups(requests.select(*group).distinct(), own, group, "left"), counts, group, "left")
    return rows.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long"))).withColumn("warning", F.when(F.col("n_candidates") == 0, "no_table_candidate_found"))
