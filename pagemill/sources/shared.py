"""The folder that driver and executors share, and tables kept there for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one process, a temporary folder
    of this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders made for each application, until clear() deletes them.
_FOLDERS: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes what this application kept in the shared folder, once its results have been used; says how much."""
    paths = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return len(paths)


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """The rows, written to the shared folder and read from there: worked out once, and again from the files
    if executors are lost."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
