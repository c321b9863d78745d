"""Posts as a stream: each video once within the watermark, windowed heat, and seen-state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.tables import INTERACTIONS


def read_posts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events as they arrive, in the shape of sources.tables.posts (published: TIMESTAMP)."""
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)
    amount = F.round(F.col("value") * 100).cast("bigint")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("published"), F.col("user_id").alias("account_id"), F.get_json_object("props", "$.k").cast("bigint").alias("video_id"), "event_type",
        *[F.when(F.col("event_type") == k, amount).alias(v) for k, v in INTERACTIONS.items()],
    )


def once(posts: DataFrame, late: str = "3 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return posts.withWatermark("published", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_heat(posts: DataFrame, window: str = "1 day") -> DataFrame:
    """Interactions of each video by window of published time."""
    return posts.groupBy(F.window("published", window), "video_id").agg(F.count("*").alias("n_posts"), F.approx_count_distinct("account_id").alias("n_accounts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in INTERACTIONS.values()])


def write(df: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
