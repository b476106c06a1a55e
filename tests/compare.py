"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def differences(spark_df, con, sql: str) -> str:
    """What differs, or an empty string."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda row: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    want = sorted(key([dict(zip(names, r))[c] for c in order]) for r in cur.fetchall())
    got = sorted(key([r[c] for c in order]) for r in spark_df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    return next((f"{order}: {a} and {b}" for a, b in zip(got, want) if a != b), "")
