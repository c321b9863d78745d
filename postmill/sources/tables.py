"""The tables, and the engine's concepts read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import first_line

#: Which interaction an event type stands for.
INTERACTIONS = {"click": "likes", "error": "comments", "signup": "collects", "purchase": "shares", "view": "plays"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as posts: one interaction count each, in hundredths of value; the others null."""
    e = table(spark, sf_dir, "events")
    amount = F.round(F.col("value") * 100).cast("bigint")
    return e.select(
        "event_id",
        F.col("ts").alias("published"),
        F.to_date("ts").alias("day"),
        F.col("user_id").alias("account_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("video_id"),
        "event_type",
        "value",
        *[F.when(F.col("event_type") == k, amount).alias(v) for k, v in INTERACTIONS.items()],
    )


#: The same in SQL, as a common table expression.
POSTS_SQL = """posts as (
  select event_id, ts as published, cast(ts as date) as day, user_id as account_id,
    cast(json_extract_string(props, '$.k') as bigint) as video_id, event_type, value,
    case when event_type = 'click' then cast(round(value * 100) as bigint) end as likes,
    case when event_type = 'error' then cast(round(value * 100) as bigint) end as comments,
    case when event_type = 'signup' then cast(round(value * 100) as bigint) end as collects,
    case when event_type = 'purchase' then cast(round(value * 100) as bigint) end as shares,
    case when event_type = 'view' then cast(round(value * 100) as bigint) end as plays
  from events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first line is the title, the source a publisher."""
    return table(spark, sf_dir, "documents").select("doc_id", first_line(F.col("text")).alias("title"), "text", "lang", "source", "n_chars")


ARTICLES_SQL = "articles as (select doc_id, split_part(text, chr(10), 1) as title, text, lang, source, n_chars from documents)"
