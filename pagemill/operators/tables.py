"""Rows of extracted tables: typing, validation, Markdown, evidence chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import fold
from pagemill.operators.keys import join_groups


def row_type(label: Column, values: Column) -> Column:
    """result, total, section_header (no values) or data; the first that fits."""
    n = fold(label)
    blank = F.forall(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) == "")
    return F.when(F.contains(n, F.lit("resultat net")), "result").when(n.rlike(r"^total|\btotal\b"), "total").when(blank, "section_header").otherwise("data")


def some(*texts: Column) -> Column:
    """The texts that aren't null, in order."""
    return F.filter(F.array(*texts).cast("array<string>"), lambda x: x.isNotNull())


def validate(n_columns: Column, n_rows: Column, confidence: Column, off_balance: Column, least: int = 3) -> Column:
    """status and the joined issues and warnings of a table. No rows are also too few."""
    issues = some(F.when(n_columns == 0, "missing_columns"), F.when(n_rows == 0, "missing_rows"), F.when(n_rows < least, "too_few_rows"))
    warnings = some(F.when(confidence < 0.45, "low_vision_confidence"), F.when(off_balance, "extracted_rows_mention_off_balance_verify_crop"))
    status = F.when(F.size(issues) > 0, "rejected").when(F.size(warnings) > 0, "warning").otherwise("approved")
    return F.struct(status.alias("status"), F.array_join(issues, ",").alias("issues"), F.array_join(F.sort_array(F.array_distinct(warnings)), ",").alias("warnings"))


def result_warnings(warnings: Column, error: Column, found: Column) -> Column:
    """A result's warnings with its error, if any, and with a mark where the table wasn't found."""
    own = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.concat(own, some(F.nullif(error, F.lit("")), F.when(~found, "target_found_false")))


def empty_result(fields: dict[str, Column]) -> Column:
    """The record of a request for which there is no candidate."""
    return F.struct(
        *(v.alias(k) for k, v in fields.items()),
        F.lit(None).cast("int").alias("selected_page"), F.lit("").alias("crop_path"), F.array().cast("array<double>").alias("bbox"), F.lit(False).alias("target_found"),
        F.array().cast("array<string>").alias("columns"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("warnings"),
        F.struct(F.lit("rejected").alias("status"), F.array(F.lit("no_candidate")).alias("issues")).alias("validation"),
    )


def row_values(values: Column, columns: Column) -> Column:
    """A map of all columns in their order, empty where the row has no value."""
    return F.map_from_arrays(columns, F.transform(columns, lambda c: clean_cell(F.try_element_at(values, c))))


def clean_cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def table_cells(results: DataFrame, key: list[str], columns: str, rows: str) -> DataFrame:
    """key, row, col, cell of each result's table: header cells in row 0, then `label` and the values by
    column; missing values are empty."""
    names = F.concat(F.array(F.lit("label")), F.col(columns))
    header = F.array(F.struct(F.lit(0).alias("row"), names.alias("cells")))
    body = F.transform(F.col(rows), lambda r, i: F.struct((i + 1).cast("int").alias("row"), F.concat(F.array(clean_cell(r["label"])), F.transform(F.col(columns), lambda c: clean_cell(F.try_element_at(r["values"], c)))).alias("cells")))
    each = results.select(*key, F.explode(F.concat(header, body)).alias("r"))
    return each.select(*key, "r.row", F.posexplode("r.cells").alias("col", "cell"))


def is_label_column(name: Column, labels: list[str]) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*labels)


def evidence_rows(results: DataFrame, key: list[str], columns: str, rows: str) -> DataFrame:
    """key, row_index from 1, label, row_type, values: a row for each row of a table that has columns."""
    fine = results.filter((F.size(columns) > 0) & (F.size(rows) > 0))
    each = fine.select(*key, columns, F.posexplode(rows).alias("_i", "_r"))
    return each.select(*key, (F.col("_i") + 1).alias("row_index"), F.trim(clean_cell(F.col("_r.label"))).alias("label"), clean_cell(F.col("_r.row_type")).alias("row_type"), row_values(F.col("_r.values"), F.col(columns)).alias("values"))


def small_region(target: Column, sector: Column, box: Column, evidence: Column) -> Column:
    """Whether a kept box of a balance sheet is to be distrusted: no four numbers, under 130 points high (220
    for a bank's liabilities), or marked by a penalty."""
    height = F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    penalties = ["penalty:note_like_balance_region", "penalty:small_balance_region", "penalty:alternate_statement_context"]
    told = F.exists(evidence, lambda e: F.lower(e).rlike("|".join(penalties)))
    bank = (target == "liability") & (sector == "bank") & (height < 220)
    return target.isin("asset", "liability") & ((F.size(box) != 4) | F.coalesce((height < 130) | bank, F.lit(False)) | told)


def usable_results(results: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The kept results of what is asked for: found, with rows, not rejected, and with a box to be trusted."""
    fine = F.col("target_found") & (F.col("n_rows") > 0) & (F.col("status") != "rejected") & ~small_region(F.col("target"), F.col("sector"), F.col("bbox"), F.col("evidence"))
    return join_groups(results.filter(fine), asked.select(*keys), keys, "left_semi")


def complete(results: DataFrame, document: str, targets: list[str], scopes: list[str]) -> DataFrame:
    """Documents that have a result for every target and scope: none of the pairs is missing."""
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(s).alias("scope")) for t in targets for s in scopes)))
    wanted = results.select(document).distinct().select(document, pairs.alias("_p")).select(document, "_p.*")
    missing = join_groups(wanted, results.select(document, "target", "scope"), [document, "target", "scope"], "left_anti")
    return join_groups(results.select(document).distinct(), missing, [document], "left_anti")


def continuation(selected: DataFrame, pages: DataFrame, candidates: DataFrame, document: str, ends: list[str], marks: list[str]) -> DataFrame:
    """document, page, next_page of selected income statements whose page lacks one of `ends`, where the next
    page's head (2500 characters) looks like a continuation and holds a candidate. pages: document, page,
    folded."""
    has = lambda c, w: F.contains(c, F.lit(w))
    whole = F.lit(True)
    for w in ends:
        whole = whole & has(F.col("folded"), w)
    again = F.lit(False)
    for w in marks:
        again = again | has(F.substring("folded", 1, 2500), w)
    open_ = join_groups(selected.select(document, "page"), pages, [document, "page"]).filter(~whole).select(document, "page", (F.col("page") + 1).alias("next_page"))
    following = join_groups(pages.filter(again).select(document, F.col("page").alias("next_page")), candidates.select(document, F.col("page").alias("next_page")), [document, "next_page"], "left_semi")
    return join_groups(open_, following, [document, "next_page"]).select(document, "page", "next_page")


#: What targets are called in messages.
TARGET_NAMES = {"asset": "Assets", "liability": "Liabilities", "income": "Income statement"}


def target_name(target: Column) -> Column:
    """A target's name for users: from TARGET_NAMES, else its own with spaces for _, Table where there is none."""
    out = F.replace(F.coalesce(F.nullif(target, F.lit("")), F.lit("Table")), F.lit("_"), F.lit(" "))
    for name, shown in TARGET_NAMES.items():
        out = F.when(F.lower(target) == name, shown).otherwise(out)
    return out


def friendly_error(error: Column, target: Column, page: Column, has_crop: Column, first: int = 1) -> Column:
    """What to tell a user about a failure; the first that fits. An error that fits none is told as it is, with the
    target's name if there is a target. Pages are counted from `first`; a lower number is none."""
    label = target_name(target)
    low = F.lower(F.coalesce(error, F.lit("")))
    has = lambda *words: low.rlike("|".join(words))
    where = some(F.when(page >= first, F.concat(F.lit("page "), page.cast("string"))), F.when(has_crop, F.lit("crop kept")))
    details = F.when(F.size(where) > 0, F.concat(F.lit(" ("), F.array_join(where, "; "), F.lit(")"))).otherwise("")
    return (
        F.when(has("insufficient_quota", "exceeded your current quota"), F.concat(label, F.lit(": the provider's quota is used up")))
        .when(has("429", "too many requests", "rate limit"), F.concat(label, F.lit(": the provider's rate limit is reached, try again later")))
        .when(has("target_found_false", "target_not_found"), F.concat(label, F.lit(": the table was not found"), details))
        .when((low != "") & (F.coalesce(target, F.lit("")) != ""), F.concat(label, F.lit(": "), error))
        .when(low != "", error)
        .otherwise("")
    )


def prompt(target: Column, scope: Column, labels: Column) -> Column:
    """The instruction for a vision model that reads one cropped table."""
    return F.concat(F.lit("Read the table "), target, F.lit(" ("), scope, F.lit(") in this image. Answer with one JSON object {columns, rows, confidence, target_found}; give amounts as text as they are printed. Rows to expect: "), F.array_join(labels, "; "))


def markdown_row(cells: list[Column]) -> Column:
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))


def chunk_text(parts: dict[str, Column], kind: Column, values: dict[str, Column]) -> Column:
    named = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in parts.items()]
    row = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("type: "), kind))
    return F.concat_ws(" | ", *named, row, *(F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in values.items()))


def chunk_id(parts: list[Column], label: Column) -> Column:
    joined = F.concat_ws("_", *parts, F.substring(label, 1, 48))
    return F.replace(fold(joined), F.lit(" "), F.lit("_"))


def normalized_row(columns: Column, values: Column, labels: list[str]) -> Column:
    """label (the first non-empty value of a label column) and values of the other columns, in their
    order, empty where missing; values is a map by column."""
    is_label = lambda c: is_label_column(c, labels)
    value = lambda c: F.coalesce(F.try_element_at(values, c), F.lit(""))
    filled = F.filter(F.transform(F.filter(columns, is_label), value), lambda v: F.trim(v) != "")
    kept = F.filter(columns, lambda c: ~is_label(c))
    return F.struct(F.coalesce(F.get(filled, F.lit(0)), F.lit("")).alias("label"), kept.alias("columns"), F.transform(kept, value).alias("values"))


def audit(selected: Column, retrieved: Column, scope_score: Column, confidence: Column, crop: Column) -> Column:
    """Why a selection doesn't count as found, the first reason that fits; null if it does."""
    return (
        F.when(selected.isNull(), "no_candidate").when(~F.coalesce(F.array_contains(retrieved, selected), F.lit(False)), "page_not_retrieved")
        .when(F.coalesce(scope_score, F.lit(0.0)) <= 0, "other_scope").when(F.coalesce(confidence, F.lit(0.0)) < 0.45, "low_confidence").when(~F.coalesce(crop, F.lit(False)), "no_crop")
    )


def evidence_summary(chunks: DataFrame, key: list[str]) -> DataFrame:
    """key, n_chunks, n_labels of the evidence of each result, and a row with null keys for all of them."""
    return chunks.rollup(*key).agg(F.count("*").alias("n_chunks"), F.count_distinct("label").alias("n_labels"), F.grouping_id().alias("_g")).filter(F.col("_g").isin(0, (1 << len(key)) - 1)).drop("_g")


def crop_metadata(candidate: Column, crop_path: Column) -> Column:
    """What is kept beside a crop, as JSON."""
    return F.to_json(F.struct(crop_path.alias("crop_path"), candidate.alias("table_candidate")))
