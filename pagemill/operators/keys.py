"""Group keys that may hold nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_key(names: list[str]) -> Column:
    """The columns as one value that is never null and equal where all columns are equal or null alike, so a
    join on it loses no row. What is grouped and joined by it is shuffled once."""
    return F.struct(*names)


def join_groups(rows: DataFrame, of: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """rows joined to `of`, which has the columns `names` too, by these; a null meets a null."""
    mine, theirs = rows.withColumn("_g", group_key(names)), of.withColumn("_g", group_key(names)).drop(*names)
    return mine.join(theirs, "_g", how).drop("_g")
