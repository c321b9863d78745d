"""Connected components over an edge table, by alternating large-star and small-star steps (all on Spark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import drop, saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    return m.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    moved = m.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return m.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root): root is the smallest node that node reaches, itself left out."""
    now = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = saved(_small_star(_large_star(now)), "stars")
        got = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        drop(now.sparkSession, now._postmill_path)
        now = new
        if tuple(got) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(got)
