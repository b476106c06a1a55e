"""Job events as a stream: windowed counts with a watermark, the latest state of each job, the state machine of
jobs, and keyed rows in buckets that a batch rewrites only where it touches them."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import StructType

from pagemill.operators.feedback import PROGRESS, TERMINAL
from pagemill.sources.shared import kept


def counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, kind, n in tumbling windows; works on a stream (append mode) and on a table."""
    by = events.withWatermark(time, late) if events.isStreaming else events
    return by.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def latest_states(events: DataFrame, key: str, time: str, tie: str, state: str) -> DataFrame:
    """key, state of the last event; update mode on a stream."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(time, tie)).alias(state))


class Buckets:
    """The last row of each key, in files by the key's hash. A batch writes only the buckets that it touches, anew
    under its own number, and then a manifest that tells for each bucket which number it has; a reader takes
    the last manifest. A batch that runs again starts from the manifest before it, so each row counts once.
    Everything is written by Spark's own committer, the manifest in one file and last, so what a lost batch left
    is never read. expire() deletes what only older manifests than the last `keep` name."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets
        self.schema = StructType.fromDDL(schema)

    def manifest(self, before: int | None = None) -> DataFrame | None:
        """bucket, v of the last manifest, or of the last before a batch's number."""
        try:
            every = self.spark.read.schema("bucket int, v long, number long").parquet(f"{self.path}/manifest")
            last = every.filter(F.lit(True) if before is None else F.col("number") < before).agg(F.max("number")).first()[0]
        except AnalysisException as e:  # no batch has been written
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if last is None else every.filter(F.col("number") == last).select("bucket", "v")

    def read(self, manifest: DataFrame | None, only: list[int] | None = None) -> DataFrame:
        """The rows that a manifest names, of some buckets (as few as there are at all)."""
        found = [] if manifest is None else manifest.filter(F.lit(True) if only is None else F.col("bucket").isin(only)).collect()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/v={r['v']}/bucket={r['bucket']}" for r in found))

    def current(self) -> DataFrame:
        return self.read(self.manifest())

    def write(self, batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        columns = self.schema.names
        batch = kept(batch.select(*columns).withColumn("bucket", bucket), "batch")
        before = self.manifest(number)
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most self.buckets
        rows = batch.unionByName(self.read(before, touched).withColumn("bucket", bucket))
        ties = [c for c in columns if c not in (self.key, self.order)]
        last = F.max_by(F.struct(*columns), F.struct(self.order, *ties)).alias("r")
        one = rows.groupBy("bucket", self.key).agg(last).select("r.*", "bucket")
        one.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        told = {r["bucket"]: r["v"] for r in before.collect()} if before is not None else {}
        told |= dict.fromkeys(touched, number)
        names = self.spark.createDataFrame([(b, v, number) for b, v in sorted(told.items())], "bucket int, v long, number long")
        names.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number:012d}")

    def expire(self, keep: int = 2) -> list[int]:
        """Deletes manifests but the last `keep`, and the versions that only the others name; returns these."""
        every = self.spark.read.schema("bucket int, v long, number long").parquet(f"{self.path}/manifest")
        numbers = sorted(r["number"] for r in every.select("number").distinct().collect())
        old, kept_numbers = numbers[:-keep], numbers[-keep:]
        named = {r["v"] for r in every.filter(F.col("number").isin(kept_numbers)).select("v").distinct().collect()}
        gone = sorted({r["v"] for r in every.select("v").distinct().collect()} - named)
        for name in (*(f"manifest/batch={n:012d}" for n in old), *(f"data/v={v}" for v in gone)):
            there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)
        return gone


def upsert_stream(events: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> DataStreamWriter:
    """A writer that keeps the row of each key that is last by `order` in Buckets under path."""
    state = Buckets(events.sparkSession, path, key, order, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema), buckets)
    return events.writeStream.foreachBatch(state.write)


JOB_STATE = "status string, step string, progress int, finished boolean"


class JobMachine(StatefulProcessor):
    """The state of a job from its events (ts, event_id, status, step), as feedback.job_states() has it: a terminal
    status stands whatever comes after it, a pending job has its last step and its largest progress. A job without
    an event for `stuck_ms` of event time fails with the step it is stuck in; a job that ended or failed `stuck_ms`
    ago is forgotten."""

    def __init__(self, job: str, stuck_ms: int):
        self.job, self.stuck_ms = job, stuck_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB_STATE)

    def _row(self, key, status: str, step: str | None, progress: int, finished: bool):
        self.state.update((status, step, progress, finished))
        return pd.DataFrame({self.job: [key[0]], "status": [status], "step": [step], "progress": pd.array([progress], "int32"), "finished": [finished]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        status, step, progress, finished = tuple(self.state.get()) if self.state.exists() else ("pending", None, 0, False)
        if finished:  # late events change nothing
            for _ in rows:
                pass
            return
        batch = pd.concat(rows).sort_values(["ts", "event_id"])
        last = 0
        for e in batch.itertuples():
            last = int(e.ts.timestamp() * 1000)
            progress = max(progress, PROGRESS.get(e.step, 0))
            status, step = e.status, e.step
            if status in TERMINAL:
                progress, finished = 100, True
                break
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(last + self.stuck_ms)
        yield self._row(key, status if finished else "pending", step, progress, finished)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if not self.state.exists():
            return
        _, step, progress, finished = tuple(self.state.get())
        if finished:
            self.state.clear()
            return
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.stuck_ms)
        yield self._row(key, "error", step, progress, True)

    def close(self) -> None:
        pass


def job_machine(events: DataFrame, job: str, late: str = "10 minutes", stuck: str = "1 day") -> DataFrame:
    """job, status, step, progress, finished whenever a job's state changes, from a stream of events (job, ts,
    event_id, status, step). The stream needs the RocksDB state store (STATE_STORE)."""
    minutes = {"minute": 1, "hour": 60, "day": 1440}
    n, unit = stuck.split()
    kind = events.schema[job].dataType.simpleString()
    processor = JobMachine(job, int(n) * minutes[unit.rstrip("s")] * 60_000)
    rows = events.select(job, "ts", "event_id", "status", "step").withWatermark("ts", late)
    return rows.groupBy(job).transformWithStateInPandas(processor, f"{job} {kind}, {JOB_STATE}", outputMode="Update", timeMode="EventTime")


#: The setting that job_machine() needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
