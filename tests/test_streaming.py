import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import feedback
from pagemill.sources import pages
from pagemill.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_of_a_stream_are_those_of_the_table_but_the_open_ones(spark, tmp_path):
    table = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type")
    table.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = jobs.counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counted").collect()}
    want = {tuple(r) for r in jobs.counts(table).collect()}
    last = table.agg(F.max("ts")).first()[0]
    assert got and got <= want
    assert all((last - r[0]).total_seconds() <= 2 * 3600 for r in want - got)


def test_latest_states_update(spark, tmp_path):
    table = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(table.schema).parquet(EVENTS.replace("events.parquet", "event[s].parquet"))
    args = ("user_id", "ts", "event_id", "event_type")
    q = jobs.latest_states(stream, *args).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("states").collect()} == {tuple(r) for r in jobs.latest_states(table, *args).collect()}


def test_file_names_and_json(spark, tmp_path):
    for name in ("Banque_Nord_2023_s1.pdf", "acme_12_2024.pdf", "plain.pdf"):
        (tmp_path / name).write_bytes(b"a\fb")
    got = {(r.issuer, r.year) for r in pages.file_names(spark, str(tmp_path)).collect()}
    assert got == {("Banque Nord", 2023), ("acme 12", 2024), ("plain", None)}
    texts = pages.pdf_pages(spark, str(tmp_path / "plain.pdf"), lambda b: b.decode().split("\f")).collect()
    assert [(r.pdf_id, r.page_number, r.page_text) for r in texts] == [("plain", 1, "a"), ("plain", 2, "b")]
    (tmp_path / "x.json").write_text('[{"code": "A"}, {"code": "B"}]')
    (tmp_path / "y.json").write_text("{broken")
    assert sorted(r.code for r in pages.json_rows(spark, str(tmp_path / "*.json"), "code string").collect() if r.code) == ["A", "B"]


def sequential(stored, fresh):
    """Places and entries after each fresh one took the first place with its job or its case."""
    places = [dict(e) for e in stored]
    for e in fresh:
        at = next((i for i, p in enumerate(places) if (e["job"] and p["job"] == e["job"]) or (e["case"] and p["case"] == e["case"])), None)
        if at is None:
            places.append(dict(e))
        else:
            places[at] = dict(e)
    return [(p["job"], p["case"], p["v"]) for p in places]


@pytest.mark.parametrize("seed,keys", [(1, 6), (2, 25), (3, 200)])
def test_saving_is_that_of_one_after_the_other(spark, seed, keys):
    r = random.Random(seed)
    entry = lambda v: {"job": r.choice([None, "", *(f"j{i}" for i in range(keys))]), "case": r.choice([None, "", *(f"c{i}" for i in range(keys))]), "v": v}
    stored, fresh = [entry(f"old{i}") for i in range(40)], [entry(f"new{i}") for i in range(80)]
    fresh += [{"job": "same", "case": "twice", "v": "first"}, {"job": "other", "case": "twice", "v": "second"}]
    a = spark.createDataFrame([(i, e["job"], e["case"], e["v"]) for i, e in enumerate(stored)], "pos long, source_job_id string, id string, v string")
    b = spark.createDataFrame([(i, e["job"], e["case"], e["v"]) for i, e in enumerate(fresh)], "seq long, source_job_id string, id string, v string").repartition(3)
    got = [(x.source_job_id, x.id, x.v) for x in feedback.saved(a, b).orderBy("pos").collect()]
    assert got == sequential(stored, fresh)
    assert feedback.saved(a.limit(0), b.limit(0)).collect() == []


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    state = jobs.Buckets(spark, str(tmp_path), "k", "t", "k long, t long, v string", 16)
    assert state.current().collect() == []
    state.write(spark.range(400).selectExpr("id AS k", "1L AS t", "'a' AS v"), 0)
    one = spark.createDataFrame([(7, 2, "b"), (7, 1, "late"), (1000, 1, "new")], "k long, t long, v string")
    state.write(one, 1)
    sizes = {p.name: len(list(p.iterdir())) for p in (tmp_path / "data").iterdir()}
    assert len([p for p in (tmp_path / "data" / "v=1").iterdir() if p.name.startswith("bucket=")]) <= 2 < sizes["v=0"]
    rows = {r.k: r.v for r in state.current().collect()}
    assert len(rows) == 401 and rows[7] == "b" and rows[8] == "a" and rows[1000] == "new"
    state.write(one, 1)  # again
    assert {r.k: r.v for r in state.current().collect()} == rows
    # A batch that was lost before its manifest leaves the state as it was.
    (tmp_path / "data" / "v=2" / "bucket=0").mkdir(parents=True)
    assert state.current().count() == 401
    state.write(spark.range(400).selectExpr("id AS k", "3L AS t", "'c' AS v"), 2)
    state.write(one.selectExpr("k", "t + 9 AS t", "v"), 3)
    assert state.expire(2) == [0] or state.expire(2) == []
    assert {r.v for r in state.current().collect()} == {"c", "b", "new"}


def test_a_stream_of_upserts(spark, tmp_path):
    table = spark.read.parquet(EVENTS).selectExpr("user_id", "event_id", "event_type")
    for i, part in enumerate(table.randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.upsert_stream(stream, str(tmp_path / "state"), "user_id", "event_id", 8).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = jobs.Buckets(spark, str(tmp_path / "state"), "user_id", "event_id", "user_id long, event_id long, event_type string", 8).current()
    want = table.groupBy("user_id").agg(F.max("event_id"), F.max_by("event_type", "event_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_machine_of_jobs_on_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    kinds = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'pending' END AS status", "CASE event_type WHEN 'view' THEN 'ensure_pdf' WHEN 'click' THEN 'crop_and_vision' WHEN 'signup' THEN 'submit' END AS step"
    table = spark.read.parquet(EVENTS).filter("event_id % 2 = 0").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id", *kinds)
    cuts = [r[0] for r in table.selectExpr("explode(percentile(unix_micros(ts), array(0.3, 0.6)))").collect()]
    low = "-1e30"
    for high in (*map(str, cuts), "1e30"):  # files in the order of time
        table.filter(f"unix_micros(ts) > {low} AND unix_micros(ts) <= {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = high
        time.sleep(1.1)
    spark.conf.set(*jobs.STATE_STORE)
    try:
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        machine = jobs.job_machine(stream, "user_id", stuck="3650 days")
        q = machine.writeStream.format("memory").queryName("machine").outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        changes = spark.table("machine").withColumn("n", F.monotonically_increasing_id())
        last = {r.user_id: tuple(r.r) for r in spark.table("machine").groupBy("user_id").agg(F.max_by(F.struct("status", "step", "progress", "finished"), F.struct("finished", "progress")).alias("r")).collect()}
        want = {r.user_id: tuple(r)[1:] for r in feedback.job_states(table, "user_id", "ts", "event_id").collect()}
        assert changes.count() >= len(want) and {k: (v[0], v[3]) for k, v in last.items()} == {k: (v[0], v[3]) for k, v in want.items()}
        assert {k: v for k, v in last.items() if v[3]} == {k: v for k, v in want.items() if v[3]}
    finally:
        spark.conf.unset(jobs.STATE_STORE[0])


def test_jobs_without_events_are_stuck(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [[(1, "2024-01-01 00:00:00", 1, "pending", "ensure_pdf"), (2, "2024-01-01 00:00:00", 2, "success", None)], [(3, "2024-01-03 00:00:00", 3, "pending", "submit")], [(3, "2024-01-03 01:00:00", 4, "pending", "submit"), (2, "2024-01-03 01:00:00", 5, "pending", "submit")]]
    for part in rows:
        spark.createDataFrame(part, "job long, ts string, event_id long, status string, step string").selectExpr("job", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "status", "step").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    spark.conf.set(*jobs.STATE_STORE)
    try:
        stream = spark.readStream.schema("job long, ts timestamp, event_id long, status string, step string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.job_machine(stream, "job", stuck="1 day").writeStream.format("memory").queryName("stuck").outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        got = {(r.job, r.status, r.step, r.progress, r.finished) for r in spark.table("stuck").collect()}
        assert (1, "error", "ensure_pdf", 5, True) in got and (2, "success", None, 100, True) in got and (3, "pending", "submit", 0, False) in got
    finally:
        spark.conf.unset(jobs.STATE_STORE[0])
