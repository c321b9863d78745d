"""The core run: exports to scored, deduplicated posts, state and artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.config import EngineConfig
from postmill.functions.text import title_key
from postmill.functions.url import canonical
from postmill.operators import scores
from postmill.operators.joins import upsert_seen
from postmill.operators.rounds import first_of_marks
from postmill.operators.select import first_reason
from postmill.sinks.export import artefacts
from postmill.sources import records


def eligible(posts: DataFrame, day: str, zone: str) -> tuple[DataFrame, DataFrame]:
    """Posts of a business day of the zone, and why the others are not."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    t = F.col("published")
    reason = first_reason(
        (F.col("title").isNull() | F.col("url").isNull(), "no_title_or_link"), (t.isNull(), "no_publish_time"), (~((t >= start) & (t < start + F.expr("interval 1 day"))), "outside_day")
    )
    x = posts.withColumn("reason", reason)
    return x.filter("reason is null").drop("reason"), x.filter("reason is not null").select("video_id", "reason")


def score(posts: DataFrame, day: str, zone: str) -> DataFrame:
    """Every eligible post's score; accounts with three posts and more have a median to stand out from."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    x = posts.withColumn("engagement", scores.engagement())
    m = x.groupBy("account_id").agg(F.percentile("engagement", F.lit(0.5)).alias("median"), F.count("*").alias("_n")).filter("_n >= 3 and median > 0").drop("_n")
    x = x.join(m, "account_id", "left")
    progress = (F.unix_micros("published") - F.unix_micros(start)) / F.lit(8.64e10)
    bonus = F.when(F.col("source") == "creator", 5.0).when(F.col("source").isin("search", "hotboard"), 3.0).otherwise(0.0)
    return x.withColumn("score", scores.post_score(progress, F.col("engagement"), F.col("median"), F.col("category") != "unclassified", bonus, F.size("missing")))


def deduplicate(scored: DataFrame) -> DataFrame:
    """Best score first, a post goes if its id, URL or title was taken by one that was accepted."""
    x = scored.withColumn("url_key", canonical(F.col("url"))).withColumn("title_key", title_key(F.col("title"))).withColumn("vid", F.xxhash64("video_id")).drop("missing", "position")
    out = first_of_marks(x, [], [("score", False), ("video_id", True)], ["video_id", "url_key", "title_key"], "vid")
    return out.drop("vid", "url_key", "title_key")


def run(spark: SparkSession, paths: list[str], day: str, config: EngineConfig | None = None, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a core run: normalised, eligible, excluded, accepted, state, and the artefacts."""
    c = config or EngineConfig()
    posts = records.normalise(records.read_raw(spark, paths), c.timezone, c.categories)
    good, excluded = eligible(posts, day, c.timezone)
    marked = deduplicate(score(good, day, c.timezone))
    accepted = marked.filter("duplicate_of is null").drop("duplicate_of")
    none = state if state is not None else spark.createDataFrame([], "video_id string, first_seen date, last_seen date, days array<date>")
    seen = upsert_seen(none, accepted.select("video_id", F.lit(day).cast("date").alias("day")), "video_id", c.seen_dates)
    return {"normalised": posts, "eligible": good, "excluded": excluded, "accepted": accepted, "duplicates": marked.filter("duplicate_of is not null").select("video_id"), "state": seen, **artefacts(accepted, c.top_n)}
