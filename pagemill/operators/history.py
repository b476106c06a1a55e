"""Results and what they replaced: versions with the time for which each was valid, and results as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.keys import group_key
from pagemill.operators.ordered import with_neighbours

#: Microseconds of a block in which one task puts a key's versions in order.
BLOCK_MICROS = 1 << 44


def versions(rows: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """Adds valid_to (when the next version of the key came, null for the one that is valid still) and
    replaced_by_<c>, the next version's c. Versions of one key are put in order in blocks of time, so no task holds
    all versions of a key. Two versions of one moment stand in any order: the first was never valid."""
    own = rows.withColumn("_key", group_key(key)).withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    marked = with_neighbours(own, "_key", "_at", [time, *columns], BLOCK_MICROS)
    out = marked.withColumnRenamed(f"next_{time}", "valid_to").withColumnsRenamed({f"next_{c}": f"replaced_by_{c}" for c in columns})
    return out.drop("_key", "_at", f"previous_{time}", *(f"previous_{c}" for c in columns))


def as_of(rows: DataFrame, key: list[str], time: str, tie: str, columns: list[str], at: Column) -> DataFrame:
    """key, valid_from, columns as they were at a time: of each column the last value that isn't null (a rerun that
    gave none leaves the earlier one). An aggregate, so versions are reduced before the shuffle."""
    when = F.struct(time, tie)
    past = rows.filter(F.col(time) <= at)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns]
    return past.groupBy(*key).agg(F.max(time).alias("valid_from"), *last)


def replaced(rows: DataFrame, key: list[str], time: str, columns: list[str], reason: str, metadata: list[str]) -> DataFrame:
    """The history of a rerun: each version that another one replaced, with the reason and the metadata (provider,
    model) of the one that did."""
    told = versions(rows, key, time, [reason, *metadata]).filter("valid_to IS NOT NULL")
    return told.select(*key, time, "valid_to", *columns, F.col(f"replaced_by_{reason}").alias("reason"), *(F.col(f"replaced_by_{c}").alias(f"new_{c}") for c in metadata))
