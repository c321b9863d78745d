"""Configured sources as a Spark data source: a partition a source, so that reads, budgets and failures happen in tasks."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postmill.functions.url import redact_errors
from postmill.sinks.scratch import stored

SCHEMA = "place int, name string, kind string, format string, bytes bigint, payload string, error string"
FORMATS = ("xml", "json", "posts")


def _open(path: str):
    """A file system and a path in it: any URI that Arrow knows, or a path on a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Read(InputPartition):
    def __init__(self, place: int, source: dict, grant: int, deadline: float, refused: str | None):
        self.place, self.source, self.grant, self.deadline, self.refused = place, source, grant, deadline, refused


class PayloadReader(DataSourceReader):
    def __init__(self, options):
        self.sources = [s for s in json.loads(options["sources"]) if s.get("enabled", True)]
        self.most = int(options.get("max_requests", 1000))
        self.max_bytes = int(options.get("max_bytes", 8 << 20))
        self.total = int(options.get("total_bytes", 256 << 20))
        self.seconds = float(options.get("total_seconds", 600))

    def partitions(self) -> list[InputPartition]:
        """Grants bytes in the order of the sources: a file takes its size, what is over a bound is refused unread."""
        out, left, asked, end = [], self.total, 0, time.time() + self.seconds
        for place, s in enumerate(self.sources):
            grant, refused = 0, None
            if asked >= self.most:
                refused = "request_budget"
            else:
                asked += 1
                try:
                    where, path = _open(s["path"])
                    size = where.get_file_info(path).size
                    if size is not None and size > self.max_bytes:
                        refused = "too_large"
                    elif size is not None and size > left:
                        refused = "byte_budget"
                    else:
                        grant = size or 0
                        left -= grant
                except Exception as e:  # noqa: BLE001  the source's failure is its row
                    refused = f"{type(e).__name__}: {e}"
            out.append(_Read(place, s, grant, end, refused))
        return out

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's call where there are no sources
            return
        s = partition.source
        row = (partition.place, str(s.get("name") or s.get("path")), s.get("kind", "media"), s.get("format", "xml"))
        try:
            if partition.refused:
                raise OSError(partition.refused)
            if row[3] not in FORMATS:
                raise ValueError(f"unknown_format {row[3]}")
            if time.time() > partition.deadline:
                raise OSError("time_budget")
            where, path = _open(s["path"])
            with where.open_input_stream(path) as f:
                data = f.read(partition.grant + 1)
            if len(data) > partition.grant:  # it grew after its bytes were granted
                raise OSError("byte_budget")
            yield (*row, len(data), data.decode("utf-8-sig", "replace"), None)
        except Exception as e:  # noqa: BLE001  the source's failure is its row
            name = type(e).__name__
            yield (*row, None, None, str(e)[:300] if name in ("OSError", "ValueError") else f"{name}: {e}"[:300])


class PayloadSource(DataSource):
    """Format "payloads". Options: sources (a JSON list of name, kind, format, path, enabled), max_requests, max_bytes (of
    one source), total_bytes (of all together), total_seconds."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PayloadReader(self.options)


def read(spark: SparkSession, sources: list[dict], **budget) -> DataFrame:
    """A row a source (SCHEMA), with its text or its error; an empty list gives no rows."""
    spark.dataSource.register(PayloadSource)
    return spark.read.format("payloads").option("sources", json.dumps(sources)).options(**budget).load().withColumn("error", redact_errors(F.col("error")))


def fetch(spark: SparkSession, sources: list[dict], **budget) -> dict[str, DataFrame]:
    """articles (schema.ARTICLE), posts (schema.POST) and report of all sources, each read once.

    report: place, name, status (success, empty: nothing could be parsed, failed), error, bytes, n_items, newest. A source
    that fails, is refused by a budget or holds nothing stops no other."""
    from postmill.sources import feeds, records

    got = stored(read(spark, sources, **budget), "payloads")  # at most total_bytes
    text = lambda form: got.filter((F.col("format") == form) & F.col("payload").isNotNull())
    xml = feeds.articles(feeds.blocks(text("xml"), "payload", "place", "name", "kind"), "block", F.col("name"), F.col("kind"), "place")
    listed = feeds.listed(text("json"), "payload", F.col("name"), F.col("kind"), "place")
    raw = records.unwrapped(text("posts").select(F.col("name").alias("raw_file"), F.col("place").alias("position"), F.try_parse_json("payload").alias("v")).filter("v is not null"))
    articles, posts = xml.unionByName(listed), records.normalise(raw)
    items = articles.select("place", "published").unionByName(posts.select(F.col("position.position").alias("place"), "published"))
    found = items.groupBy("place").agg(F.count("*").alias("n_items"), F.max("published").alias("newest"))
    report = got.drop("payload").join(found, "place", "left").fillna(0, ["n_items"])
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n_items") == 0, "empty").otherwise("success")
    return {"articles": articles.drop("place"), "posts": posts, "report": report.select("place", "name", status.alias("status"), "error", "bytes", "n_items", "newest")}


def health(spark: SparkSession, sources: list[dict], **budget) -> DataFrame:
    """(place, name, status, error, bytes, image_candidates, image_kinds): whether each XML feed can be read and holds pictures."""
    from postmill.sources import feeds

    got = stored(read(spark, sources, **budget), "health")
    found = feeds.pictures(feeds.blocks(got.filter("payload is not null"), "payload", "place"), ["place"])
    found = found.groupBy("place").agg(F.count("*").alias("image_candidates"), F.array_sort(F.collect_set("kind")).alias("image_kinds"))
    x = got.drop("payload").join(found, "place", "left").fillna(0, ["image_candidates"])
    status = F.when(F.col("error").isNotNull(), "unreachable").when(F.col("image_candidates") > 0, "reachable_with_images").otherwise("reachable_no_images")
    return x.select("place", "name", status.alias("status"), "error", "bytes", "image_candidates", F.coalesce("image_kinds", F.array().cast("array<string>")).alias("image_kinds"))
