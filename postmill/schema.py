"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = ("likes", "comments", "shares", "collects", "plays")

POST = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("video_id", "source", "title", "account_id", "account_name", "url")]
    + [T.StructField("published", T.TimestampType())]
    + [T.StructField(x, T.LongType()) for x in METRICS]
    + [T.StructField("duration_seconds", T.DoubleType()), T.StructField("keyword", T.StringType()), T.StructField("category", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("raw_file", T.StringType())]
)

ARTICLE = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("source", "source_kind", "title", "url", "domain", "summary")] + [T.StructField("published", T.TimestampType())]
)
