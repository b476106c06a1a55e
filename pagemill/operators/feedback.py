"""Idempotent feedback upserts, reports and the state of jobs."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import entry_id, optional_int
from pagemill.operators.classes import classes
from pagemill.sources.shared import kept

# Reasons that a failure can be given, and words for verdicts.
REASONS = ("WRONG_PAGE", "WRONG_SCOPE", "WRONG_TABLE", "BAD_CROP", "PARTIAL_TABLE", "MISSING_ROWS", "OCR_ERROR", "OTHER")
PASS_WORDS = ("pass", "passed", "ok", "valid", "correct")
FAIL_WORDS = ("fail", "failed", "ko", "wrong", "incorrect")


def verdict(value: Column) -> Column:
    """PASS or FAIL from a user's word; another word is an error of the row."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*PASS_WORDS), "PASS").when(v.isin(*FAIL_WORDS), "FAIL").otherwise(F.raise_error(F.concat(F.lit("no verdict: "), v)).cast("string"))


def reason(value: Column, reasons=REASONS) -> Column:
    """A failure's reason in upper case, null if blank; an unknown one is an error of the row."""
    v = F.upper(F.trim(value))
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit(None).cast("string")).when(v.isin(*reasons), v).otherwise(F.raise_error(F.concat(F.lit("no such reason: "), v)).cast("string"))


def entries(jobs: DataFrame, validated_at: Column) -> DataFrame:
    """Benchmark entries from judged jobs (job_id, company, year, report, scope, target, predicted_page,
    expected_page, verdict, reason): a passed job expects the page that was predicted, and has no reason."""
    found = verdict(F.col("verdict"))
    rows = jobs.withColumn("_v", found).withColumn("_p", optional_int(F.col("predicted_page")))
    passed = F.col("_v") == "PASS"
    return rows.select(
        entry_id([F.col(c) for c in ("company", "year", "report", "scope", "target")]).alias("id"),
        F.col("job_id").alias("source_job_id"), "company", "year", "report", "scope", "target",
        F.when(passed, F.col("_p")).otherwise(optional_int(F.col("expected_page"))).alias("expected_page"), F.col("_p").alias("predicted_page"),
        F.col("_v").alias("validation_result"), F.when(~passed, reason(F.col("reason"))).alias("failure_reason"), validated_at.alias("validated_at"),
    )


def saved(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries (pos and others) after fresh ones (seq and the same others) came in the order of seq: each takes the
    place of the first entry, stored or fresh, that has its source_job_id or its id at that time, and else stands
    at the end, in the order of arrival. Blank and null keys meet nothing.

    Entries that no key connects don't concern each other, so only classes of entries that share keys are gone
    through in order, a class by one task that holds the class's places (not the entries that came and went);
    entries without a class are appended, or stay, where they lie."""
    columns = [c for c in stored.columns if c != "pos"]
    end = stored.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_end"))  # one row
    old = stored.select(F.col("pos").cast("long").alias("_at"), F.lit(0).alias("_n"), *columns)
    new = fresh.select(F.col("seq").cast("long").alias("_at"), F.lit(1).alias("_n"), *columns)
    rows = kept(old.unionByName(new).withColumn("_row", F.monotonically_increasing_id()), "entries")
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    key = lambda kind, c: F.when(filled(c), F.concat(F.lit(kind), F.col(c).cast("string")))
    keyed = rows.select("_row", "_n", F.array_compact(F.array(key("job ", "source_job_id"), key("case ", "id"))).alias("_keys"))
    # An entry's keys are one class; classes that hold no fresh entry don't change.
    links = keyed.filter(F.size("_keys") > 1).select(F.col("_keys")[0].alias("a"), F.col("_keys")[1].alias("b"))
    first = keyed.filter(F.size("_keys") > 0).select("_row", "_n", F.col("_keys")[0].alias("node"))
    of = first.join(classes(links), "node", "left").select("_row", "_n", F.coalesce("class", "node").alias("_class"))
    touched = of.groupBy("_class").agg(F.max("_n").alias("_any")).filter("_any = 1").select("_class")
    of = kept(of.drop("_n").join(touched, "_class"), "touched")
    met = rows.join(of, "_row").repartition("_class").sortWithinPartitions("_class", "_n", "_at")
    moves = met.select("_class", "_n", "_at", "_row", F.coalesce(F.col("source_job_id").cast("string"), F.lit("")).alias("job"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("case")).mapInArrow(_in_order, "_row long, place long, appended boolean")
    placed = rows.join(moves, "_row").drop("_row", "_n", "_at")
    alone = rows.join(of.select("_row"), "_row", "left_anti").select(*columns, F.col("_at").alias("place"), (F.col("_n") == 1).alias("appended"))
    whole = placed.unionByName(alone).join(F.broadcast(end))
    return whole.select(F.when(F.col("appended"), F.col("_end") + 1 + F.col("place")).otherwise(F.col("place")).alias("pos"), *columns)


def _in_order(batches):
    """_row, place, appended of the entry that stands at each place of a class in the end. Rows come by class, the
    stored ones first, each by its place or arrival."""
    current, slots = None, []

    def standing():
        rows = [(row, at, new) for row, at, new, _, _ in slots]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["_row", "place", "appended"])

    by_key: dict[tuple[str, str], list[int]] = {}

    def first_of(kind: str, value: str) -> int | None:
        """The first place that has the key now: places that lost it are taken off their heap on the way."""
        heap = by_key.get((kind, value)) if value else None
        while heap:
            if slots[heap[0]][3 if kind == "job" else 4] == value:
                return heap[0]
            heapq.heappop(heap)
        return None

    def put(place: int, entry: tuple) -> None:
        for kind, value in (("job", entry[3]), ("case", entry[4])):
            if value:
                heapq.heappush(by_key.setdefault((kind, value), []), place)

    for batch in batches:
        for name, fresh, at, row, job, case in zip(*(batch.column(c).to_pylist() for c in ("_class", "_n", "_at", "_row", "job", "case"))):
            if name != current:
                if slots:
                    yield standing()
                current = name
                slots.clear()
                by_key.clear()
            found = [p for p in (first_of("job", job), first_of("case", case)) if p is not None] if fresh else []
            if found:
                place = min(found)
                slots[place] = (row, *slots[place][1:3], job, case)
            else:
                place = len(slots)
                slots.append((row, at, bool(fresh), job, case))
            put(place, slots[place])
    if slots:
        yield standing()


def upsert(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, one for each key: a fresh row replaces a stored one, the latest of several wins.
    An aggregate picks it, so rows of a key are reduced before the shuffle."""
    columns = stored.columns
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    last = F.max_by(F.struct(*columns), F.struct("_fresh", order, *(c for c in columns if c not in (key, order)))).alias("r")
    return both.groupBy(key).agg(last).select("r.*")


def report(rows: DataFrame, group: list[str], passed: Column) -> DataFrame:
    """total, passed, failed and accuracy of each group."""
    got = rows.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    return got.select(*group, "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.round(F.col("passed") / F.col("total"), 4).alias("accuracy"))


def latest(events: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """The last row of each key by time, then tie."""
    pick = F.max_by(F.struct(time, tie, *columns), F.struct(time, tie)).alias("r")
    return events.groupBy(key).agg(pick).select(key, "r.*")


def previous_pages(selected: DataFrame, key: list[str], time: str) -> DataFrame:
    """key, page of the last selection; null pages don't count."""
    fine = selected.filter(F.col("page").isNotNull())
    return fine.groupBy(*key).agg(F.max_by("page", F.struct(time, "page")).alias("page"))


def case_report(cases: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Cases with their outcome: passed if the selected page is the expected one and a crop exists; a case
    without an outcome failed with not_run."""
    rows = cases.join(outcomes, key, "left")
    same = F.coalesce(F.col("selected_page") == F.col("expected_page"), F.lit(False))
    crop = F.coalesce(F.col("crop_exists"), F.lit(False))
    why = F.when(F.col("selected_page").isNull(), "not_run").when(~same, "wrong_page").when(~crop, "no_crop")
    return rows.withColumn("passed", same & crop).withColumn("failure", why)


def filtered_cases(cases: DataFrame, company: str = "", target: str = "", limit: int | None = None, order: str = "pos") -> DataFrame:
    """Cases whose company and target hold the given words, whatever their case; the first `limit` in order."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w.lower()))
    rows = cases.filter(has("company", company) & has("target", target))
    return rows if limit is None else rows.orderBy(order).limit(limit)


#: Progress of a pending job by its step.
PROGRESS = {"submit": 0, "ensure_pdf": 5, "external_submit": 5, "external_running": 10, "crop_and_vision": 30}
TERMINAL = ("success", "error", "partial")


def job_states(events: DataFrame, job: str, time: str, tie: str) -> DataFrame:
    """job, status, step, progress, finished from events (status, step): the first terminal status stands, for
    nothing changes a finished job; else the last event, with the largest progress so far. Events are
    reduced before the shuffle."""
    known = F.create_map(*(x for k, v in PROGRESS.items() for x in (F.lit(k), F.lit(v))))
    ended = F.col("status").isin(*TERMINAL)
    at = F.struct(time, tie)
    row = F.struct("status", "step")
    got = events.groupBy(job).agg(
        F.min_by(F.when(ended, row), F.when(ended, at)).alias("_end"), F.max_by(row, at).alias("_last"),
        F.max(F.coalesce(F.try_element_at(known, F.col("step")), F.lit(0))).alias("_p"),
    )
    done = F.col("_end").isNotNull()
    state = F.coalesce("_end", "_last")
    return got.select(job, F.when(done, state["status"]).otherwise("pending").alias("status"), state["step"].alias("step"), F.when(done, 100).otherwise(F.col("_p")).alias("progress"), done.alias("finished"))
