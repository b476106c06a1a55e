"""Where the engine's queries and their SQL are registered, and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table whose files give fewer splits than there are cores, dealt to all of them before its texts are worked
    on; one of more splits, as any large table is, stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def fold_sql(x: str) -> str:
    c = f"lower(coalesce({x}, ''))"
    for a, b in T.LIGATURES.items():
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g'), '[\\x09-\\x0d\\x1c-\\x20]+', ' ', 'g'))"


def loosen_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"


def loose_sql(x: str) -> str:
    return loosen_sql(fold_sql(x))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def list_sql(texts) -> str:
    return "[" + ", ".join(map(quote, texts)) + "]"


def hits_sql(words, f: str = "f", l: str = "l") -> str:  # noqa: E741
    """A list of hits, from the folded and the loosened text."""
    tests = [f"CASE WHEN contains({f}, {quote(w)})" + (f" OR contains({l}, {quote(T.loose_keyword(w))})" if len(w.split()) > 1 else "") + f" THEN {quote(w)} END" for w in words]
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"
