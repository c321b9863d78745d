"""Intermediate rows in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset a temporary one, if all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = getattr(spark.sparkContext, "_postmill_scratch", None) or tempfile.mkdtemp(prefix="postmill-")
        spark.sparkContext._postmill_scratch = top
    return f"{top.rstrip('/')}/postmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again: lineage ends here, and no lost executor undoes it. Deleted at the driver's end."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._postmill_path = path
    if not _written:
        atexit.register(_clean)
    _written[path] = df.sparkSession
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing will read it again."""
    path = df._postmill_path
    spark = _written.pop(path, None)
    if spark is not None:
        _delete(spark, path)


_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    """At the driver's end; a context that was stopped before keeps its files."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
