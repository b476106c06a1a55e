"""Geometry of lines and boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.keys import group_key, join_groups


def densest_cluster(lines: DataFrame, page: list[str], top: str, bottom: str, label: str, gap: float) -> DataFrame:
    """Of each page, the run of lines without a vertical gap over `gap` that has most distinct
    labels, then most lines; the first on ties. n_labels, n_lines, y0, y1. Two lines or fewer are a run in
    any case."""
    w = Window.partitionBy(*page).orderBy(top, bottom, label)
    few = F.count("*").over(Window.partitionBy(*page)) <= 2
    new = ((F.col(top) - F.lag(bottom).over(w) > gap) & ~few).cast("int")
    runs = lines.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_run", F.sum("_new").over(w))
    sizes = runs.groupBy(*page, "_run").agg(F.count_distinct(label).alias("n_labels"), F.count("*").alias("n_lines"), F.min(top).alias("y0"), F.max(bottom).alias("y1"))
    best = F.max_by(F.struct("n_labels", "n_lines", "y0", "y1"), F.struct("n_labels", "n_lines", -F.col("_run"))).alias("b")
    return sizes.groupBy(*page).agg(best).select(*page, "b.*")


def nearest_pair(left: DataFrame, right: DataFrame, page: list[str], y: str, key: str, limit: float) -> DataFrame:
    """Of each page, the left and right line with the least vertical distance of at most limit; ties
    by key. Right lines are dealt to bands of `limit`, so only neighbouring bands are compared."""
    band = F.floor(F.col(y) / limit)
    a = left.select(*page, F.col(y).alias("y_left"), F.col(key).alias("left_key"), band.alias("_band"))
    b = right.select(*page, F.col(y).alias("y_right"), F.col(key).alias("right_key"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    near = F.abs(F.col("y_left") - F.col("y_right"))
    pairs = join_groups(a, b, [*page, "_band"]).withColumn("dy", near).filter(near <= limit)
    best = F.min(F.struct("dy", "left_key", "right_key")).alias("p")
    return pairs.groupBy(*page).agg(best).select(*page, "p.*")


def bounds_below(lines: DataFrame, page: list[str], top: str, bottom: str, start: Column, boundary: Column, anchor: Column) -> DataFrame:
    """first_boundary: the least top of a boundary line under start; end_anchor: the largest bottom
    of an anchor line above that boundary; y_end: which of both ends the table."""
    own = lines.withColumn("_g", group_key(page))
    first = own.groupBy("_g").agg(F.min(F.when(boundary & (F.col(top) > start + 8), F.col(top))).alias("first_boundary"))
    rows = own.join(first, "_g")
    below = F.coalesce(F.col(bottom) < F.col("first_boundary"), F.lit(True))
    out = rows.groupBy(*page, "first_boundary").agg(F.max(F.when(anchor & below, F.col(bottom))).alias("end_anchor"))
    y_end = F.coalesce(F.col("end_anchor") + 4, F.col("first_boundary") - 2)
    return out.withColumn("y_end", y_end)


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box with its corners in order, within the page."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    a, b, c, d = clamp(x0, width), clamp(y0, height), clamp(x1, width), clamp(y1, height)
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def candidate_rank(retrieval: Column, confidence: Column, scope: Column, signature: Column, anchor: Column, penalty: Column) -> Column:
    return F.greatest(0.50 * retrieval + 0.25 * confidence + 0.10 * scope + 0.12 * signature + 0.03 * anchor + penalty, F.lit(0.0))


def income_penalty(signature: Column, anchor: Column, whole_page: Column, titled: Column) -> Column:
    """What a candidate of an income statement loses for the whole page as its box and for an unconfirmed
    title, and gains for a dense signature."""
    lost = F.when(whole_page & (signature < 0.10) & (anchor < 0.10), 0.16).otherwise(0.0) + F.when(~titled & (signature < 0.15), 0.10).otherwise(0.0)
    return F.when(signature >= 0.35, 0.08).otherwise(0.0) - lost


def ranked_candidates(candidates: DataFrame, pages: DataFrame, document: list[str], page: str) -> DataFrame:
    """Candidates (page, confidence, income, whole_page, titled) with their page's scores (score, scope_score,
    sig, anchor_score; 0 where the page has none), rank_score and rank by it, then page."""
    terms = ["score", "scope_score", "sig", "anchor_score"]
    rows = join_groups(candidates, pages.select(*document, page, *terms), [*document, page], "left").fillna(0.0, terms)
    penalty = F.when(F.col("income"), income_penalty(F.col("sig"), F.col("anchor_score"), F.col("whole_page"), F.col("titled"))).otherwise(0.0)
    rows = rows.withColumn("rank_score", candidate_rank(F.col("score"), F.col("confidence"), F.col("scope_score"), F.col("sig"), F.col("anchor_score"), penalty))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*document).orderBy(F.desc("rank_score"), page)))


def least_hits(n: Column, income: bool) -> Column:
    """How many of n signature lines a region must hold."""
    share, floor = (0.22, 8) if income else (0.25, 7)
    return F.when(n <= 15, F.greatest(F.floor(n * 0.35), F.lit(4))).otherwise(F.greatest(F.floor(n * share), F.lit(floor)))
