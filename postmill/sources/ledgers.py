"""Delivery ledgers: JSON files of entries, found by their canonical name, else by what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.select import best
from postmill.operators.text_rules import ladder


def discover(spark: SparkSession, folder: str, owner: str, canonical: str = "ledger.json") -> DataFrame:
    """(path, found_by, problem): the ledgers of a folder. A file counts by its name, or if it has entries; one that is no
    JSON, or another owner's, is listed with its problem."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    x = t.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    named = F.substring_index("path", "/", -1) == canonical
    holds = F.try_variant_get("v", "$.entries", "array<variant>").isNotNull()
    who = F.try_variant_get("v", "$.owner", "string")
    x = x.withColumn("found_by", F.when(named, "name").when(holds, "content")).filter("found_by is not null")
    problem = ladder((F.col("v").isNull(), "not_json"), (~holds, "no_entries"), (who.isNull() | (who != owner), "other_owner"), otherwise="")
    return x.select("path", "found_by", F.nullif(problem, F.lit("")).alias("problem"), "v")


def entries(ledgers: DataFrame) -> DataFrame:
    """(video_id, status, at, path): the latest entry of each video over all sound ledgers; those found by name win ties."""
    x = ledgers.filter("problem is null").select("path", "found_by", F.explode(F.try_variant_get("v", "$.entries", "array<variant>")).alias("e"))
    g = lambda k: F.try_variant_get("e", f"$.{k}", "string").alias(k)
    x = x.select(g("video_id"), g("status"), g("at"), "path", "found_by").filter("video_id is not null and video_id <> ''")
    return best(x, ["video_id"], F.desc("at"), F.desc("found_by"), F.asc("path")).select("video_id", "status", "at", "path")
