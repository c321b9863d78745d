"""What the operators share: reading the input, a folder that all executors see, and shipping this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch; whole texts make Spark's 10000 a large piece of memory.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, where it isn't on their path already (once a context); smaller Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_postmill_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(), "postmill.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(top):
                for x in names:
                    if x.endswith(".py"):
                        z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), os.path.dirname(top)))
        sc.addPyFile(path)
    sc._postmill_shipped = True


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset a temporary one, if all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = getattr(spark.sparkContext, "_postmill_tmp", None) or tempfile.mkdtemp(prefix="postmill-")
        spark.sparkContext._postmill_tmp = top
    return f"{top.rstrip('/')}/postmill/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete what saved() wrote, once nothing will read it again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.removesuffix("/*"))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and no executor's loss undoes it."""
    path = shared(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._postmill_path = path
    transient(df.sparkSession, path)
    return out


def transient(spark: SparkSession, path: str) -> None:
    """Have the path deleted at the driver's end."""
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    """At the driver's end: what was written for its time is of no more use. A context that was stopped before keeps its files."""
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            drop(spark, path)


def row_key(text: Column, doc_id: Column) -> Column:
    """A null-safe key of a document row; rows with equal id and text have the same."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\0")), F.coalesce(text, F.lit("")))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text (null: empty): the key of decisions that follow from the text alone."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


#: Digests that a join may broadcast, counted first; beyond it the join shuffles.
BROADCAST_DIGESTS = 500_000


def without(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose text has none of these (distinct) digests, under any column names."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    few = digests.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    digests = digests.toDF(name)
    return docs.withColumn(name, text_digest(F.col("text"))).join(F.broadcast(digests) if few else digests, name, "left_anti").select(*docs.columns)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, with documents' types, whatever else the table has."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return df.select(*[F.col(x).cast(kinds[x]).alias(x) for x in names])
