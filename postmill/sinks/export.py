"""Exports: artefacts of a run, sanitised rewrites, manifests and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.select import ranked
from postmill.sinks.packages import put_text

#: Columns that an export may hold, and keys that it must not.
ALLOWED = ("video_id", "source", "title", "account_id", "account_name", "url", "published", "likes", "comments", "shares", "collects", "plays", "duration_seconds", "keyword")
SENSITIVE_KEY = r"(?i)(cookie|token|secret|password|session|authorization|signature)"


def artefacts(scored: DataFrame, top_n: int = 30) -> dict[str, DataFrame]:
    """The hot board, the benchmark videos (creators only, marked where plays are unknown), the candidates, a report row."""
    order = (F.desc("score"), F.asc("video_id"))
    top = ranked(scored.orderBy(*order).limit(top_n), "rank", *order)
    flag = F.when(F.col("plays").isNull(), F.lit("play_count_missing"))
    return {
        "hotboard": top,
        "benchmark": top.filter("source = 'creator'").withColumn("flag", flag),
        "candidates": top.withColumn("flag", flag),
        "report": scored.agg(F.count("*").alias("accepted"), F.count_if(F.col("plays").isNull()).alias("plays_missing"), F.max("score").alias("best_score")),
    }


def write_artefacts(parts: dict[str, DataFrame], folder: str) -> None:
    """A file of JSON lines each, replaced by one rename, so a reader finds the old file or the new one. top_n rows at most."""
    for name, df in parts.items():
        put_text(df.sparkSession, f"{folder}/{name}.jsonl", "".join(f"{r}\n" for (r,) in df.select(F.to_json(F.struct(*df.columns))).collect()))


def sanitised(df: DataFrame, cap: int | None = None, order: list | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Only allowed columns; a cap over all files; the names of removed columns and of sensitive ones among them."""
    import re

    keep = [c for c in ALLOWED if c in df.columns]
    removed = [c for c in df.columns if c not in keep]
    out = df.select(*keep)
    if cap is not None:
        out = df.orderBy(*(order or [F.col("raw_file"), F.col("position")])).limit(cap).select(*keep)
    return out, removed, [c for c in removed if re.search(SENSITIVE_KEY, c)]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, with paths relative to it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    top = folder.split(":", 1)[-1].rstrip("/") if ":" in folder else folder.rstrip("/")
    top = "/" + top.lstrip("/")
    return f.select(F.substring(name, len(top) + 2, 10_000).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Where a manifest and the files differ, in either direction: path, problem."""
    e, f = expected.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s")), found
    x = e.join(f, "path", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_s").isNull(), "unlisted").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "content")
    return x.select("path", problem.alias("problem")).filter("problem is not null")


def content_hash(files: DataFrame) -> str:
    """One SHA-256 over path, length and digest of a package's files, by path: equal packages have equal hashes."""
    line = F.concat_ws("|", "path", "bytes", "sha256")
    row = files.select(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h")).first()
    return row.h


def publish(spark: SparkSession, df: DataFrame, root: str, name: str, current: dict | None) -> dict:
    """A package under a path of its own revision, then a pointer to it. If its content is the current one's, nothing is
    written and the current pointer comes back."""
    revision = (current or {}).get("revision", 0) + 1
    path = f"{root}/{name}-r{revision}"
    df.write.mode("errorifexists").parquet(path)
    digest = spark.read.parquet(path).select(F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.count("*").alias("n")).first()
    mark = f"{digest.n}-{digest.x}"
    if current and current.get("content") == mark:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return current
    return {"path": path, "revision": revision, "content": mark, "supersedes": (current or {}).get("path")}
