"""URL filters by a sorted digest array.

Rules (host, path, verdict) become a file of 64-bit xxhash keys in sorted order beside the rules' full
strings. Executors map the keys into memory and probe them by vectorised binary search, with every host
suffix and path prefix of a url that could be a rule; a hit counts only if the stored string is equal,
so collisions do no harm. The longest fitting rule decides.

The array travels as a broadcast if it has at most MAX_BYTES. A larger one is cut by digest into parts of at
most about that size, and into so many that the distinct candidates of a part, which are probed in one
place, are about PART_NAMES.

A rule fits its host and all subdomains, if the url's path starts with the rule's. A null url, or
one without ://, has an empty host and path. No rule: null, and the default verdict. Rules that
repeat: block wins over allow. Repeated rows get a verdict each, an empty table none; columns beside
page_id and url are not read.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, frequent_join, rows_of, ship

MAX_BYTES = 64 << 20
#: Distinct candidates that are probed in one place.
PART_NAMES = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = str.maketrans(_UPPER, _LOWER)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted keys in a memory-mapped file, the rules' strings and verdicts in the same order."""

    def __init__(self, rules: list[Rule]):
        best: dict[str, str] = {}
        for host, path, verdict in rules:
            name = host.translate(_FOLDED) + path
            best[name] = "block" if "block" in (verdict, best.get(name)) else verdict
        rows = sorted((digest(k), k, v) for k, v in best.items())
        self.keys = np.array([r[0] for r in rows], "<i8").tobytes()
        self.names, self.verdicts = [r[1] for r in rows], [r[2] for r in rows]
        self.labels = sorted({r[0].count(".") + 1 for r in rules})
        self.paths = sorted({len(r[1]) for r in rules})
        self.bytes = len(self.keys) + sum(len(n.encode()) + 64 for n in self.names)
        self._map = None

    def __getstate__(self):
        return self.__dict__ | {"_map": None}

    def mapped(self) -> np.ndarray:
        if self._map is None:
            with tempfile.NamedTemporaryFile(delete=False) as f:
                f.write(self.keys)
            self._map = np.memmap(f.name, "<i8", "r") if self.keys else np.zeros(0, "<i8")
            os.unlink(f.name)  # the map stays
        return self._map

    def find(self, digests: np.ndarray, names: pa.Array) -> np.ndarray:
        """The place of each string, whose digest is given, among the rules, or -1."""
        keys = self.mapped()
        out = np.full(len(names), -1)
        if not len(keys):
            return out
        at = np.searchsorted(keys, digests)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == digests))
        for i, j, name in zip(hit.tolist(), at[hit].tolist(), names.take(pa.array(hit)).to_pylist()):
            while j < len(keys) and keys[j] == digests[i]:
                if self.names[j] == name:
                    out[i] = j
                    break
                j += 1
        return out


def digest(name: str) -> int:
    """As Spark's xxhash64()."""
    return int(np.uint64(xxhash.xxh64_intdigest(name, seed=42)).astype(np.int64))


def candidates(labels: list[int], paths: list[int]) -> Column:
    """Of columns host and path: the strings of rules that could fit, the shorter ones first."""
    parts = F.split("host", r"\.")
    hosts = F.filter(F.array(*(F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in labels)), lambda h: h.isNotNull())
    tails = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in paths)), lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(tails, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", max_bytes: int = MAX_BYTES, part_names: int = PART_NAMES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of page_id and url."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    array = DigestArray(rules)
    names = candidates(array.labels, array.paths) if rules else F.expr("cast(array() as array<string>)")
    if array.bytes > max_bytes:
        return _parted(rows, names, array, default, max_bytes, part_names)
    shared = spark.sparkContext.broadcast(array)

    def run(batches):
        own = shared.value
        for batch in batches:
            strings, digests = batch.column("names"), batch.column("digests")
            of = np.repeat(np.arange(batch.num_rows), np.diff(strings.offsets.to_numpy()))
            place = own.find(digests.flatten().to_numpy(), strings.flatten())
            hit = np.flatnonzero(place >= 0)
            size = np.array([len(own.names[j]) for j in place[hit].tolist()], int)
            best = np.full(batch.num_rows, -1)
            order = np.lexsort((size, of[hit]))  # the last of a row is its longest
            best[of[hit][order]] = place[hit][order]
            found = [None if j < 0 else own.names[j] for j in best.tolist()]
            verdicts = [default if j < 0 else own.verdicts[j] for j in best.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    rows = rows.withColumn("names", names).withColumn("digests", F.transform("names", lambda x: F.xxhash64(x)))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _parted(rows: DataFrame, names: Column, array: DigestArray, default: str, max_bytes: int, part_names: int) -> DataFrame:
    """The same with an array in parts by digest, of at most about max_bytes of rules and part_names candidates."""
    spark = rows.sparkSession
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(names).alias("rule"))
    counted = checkpoint(asked.groupBy("rule").agg(F.count("*").alias("n")).withColumn("digest", F.xxhash64("rule")))
    parts = max(-(-array.bytes // max(max_bytes, 1 + array.bytes // (len(array.names) or 1))), -(-rows_of(counted) // part_names))
    part = lambda d: F.expr(f"pmod(shiftrightunsigned({d}, 16), {parts})")
    rules = spark.createDataFrame(list(zip(array.names, array.verdicts)), "rule string, rule_verdict string")
    rules = rules.withColumn("digest", F.xxhash64("rule")).withColumn("part", part("digest"))

    def probe(t: pa.Table, own: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(own, [("digest", "ascending")])
        here = DigestArray([])
        here.keys = own.column("digest").take(order).to_numpy().astype("<i8").tobytes()
        here.names, verdicts = own.column("rule").take(order).to_pylist(), own.column("rule_verdict").take(order).to_pylist()
        place = here.find(t.column("digest").to_numpy(), t.column("rule").combine_chunks())
        hit = np.flatnonzero(place >= 0)
        found = t.select(["rule", "n"]).take(pa.array(hit))
        return found.append_column("rule_verdict", pa.array([verdicts[j] for j in place[hit].tolist()], pa.string()))

    hits = counted.withColumn("part", part("digest")).groupBy("part").cogroup(rules.groupBy("part")).applyInArrow(probe, "rule string, n long, rule_verdict string")
    met = frequent_join(asked, checkpoint(hits), ["rule"], "n", max(counted.agg(F.sum("n")).first()[0] or 1, 1), "inner")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
