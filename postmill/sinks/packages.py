"""Packages that are published whole: staged, moved to a revision of their own, then pointed at by one atomic rename.

    root/.staging/<id>/      a writer's own folder, which nobody reads
    root/<name>-r<n>/        a revision: a folder a table, and what it holds (_content.json)
    root/<name>.current      the pointer: revision, path, content, supersedes

A writer that is killed before the pointer's rename leaves the old revision in force; of two writers of one revision the
second fails. Content is a digest of the tables' rows in any order, so equal content is found before anything is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Collision(RuntimeError):
    """Another writer has published this revision with other content."""


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rename(spark: SparkSession, old: str, new: str, overwrite: bool = False) -> None:
    """One rename of the file system; without overwrite it fails where the new name is taken."""
    jvm, p, fs = _paths(spark, old)
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    array = spark.sparkContext._gateway.new_array(options, 1)
    array[0] = options.OVERWRITE if overwrite else options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(new)), array)


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _paths(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _paths(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null where there is none."""
    jvm, p, fs = _paths(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file without a moment in which it is missing or half written."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    _, p, fs = _paths(spark, temporary)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    rename(spark, temporary, path, overwrite=True)


def digest(df: DataFrame) -> str:
    """Of a table's columns and rows, in whatever order: count, and sums of two hashes of 64 bits."""
    names = sorted(df.columns)
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    h = df.select(F.xxhash64(row).alias("a"), F.xxhash64(row, F.lit("again")).alias("b"))
    sums = h.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"]).first()
    types = ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names)
    return f"{types}|{sums.n}|{sums.a}|{sums.b}"


def pointer(spark: SparkSession, root: str, name: str) -> dict | None:
    text = read_text(spark, f"{root}/{name}.current")
    return json.loads(text) if text else None


def load(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """The tables of the revision in force."""
    now = pointer(spark, root, name)
    return {t: spark.read.parquet(f"{now['path']}/{t}") for t in now["tables"]} if now else {}


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, name: str, at: Callable[[str], None] = lambda step: None) -> dict:
    """Publishes the tables; returns the pointer in force. Equal content is not written again. at: called with staged and
    moved, before the step that follows (tests stop there)."""
    before = pointer(spark, root, name)
    content = {t: digest(df) for t, df in sorted(tables.items())}
    if before and before["content"] == content:
        return before
    revision = (before or {}).get("revision", 0) + 1
    path = f"{root}/{name}-r{revision}"
    mark = json.dumps(content, sort_keys=True)
    if not exists(spark, path):
        stage = f"{root}/.staging/{uuid.uuid4().hex}"
        try:
            for t, df in tables.items():
                df.write.parquet(f"{stage}/{t}")
            put_text(spark, f"{stage}/_content.json", mark)
            at("staged")
            try:
                rename(spark, stage, path)
            except Exception as e:
                if not exists(spark, path):
                    raise
                if read_text(spark, f"{path}/_content.json") != mark:
                    raise Collision(path) from e
        finally:
            remove(spark, stage)
    elif read_text(spark, f"{path}/_content.json") != mark:  # a writer's that did not live to point at it, or is about to
        raise Collision(path)
    at("moved")
    now = {"revision": revision, "path": path, "tables": sorted(tables), "content": content, "supersedes": (before or {}).get("path")}
    put_text(spark, f"{root}/{name}.current", json.dumps(now, sort_keys=True))
    return now


def self_describing(files: list[dict], extra: Mapping | None = None) -> str:
    """A manifest whose total_bytes counts the files and the manifest itself. The total has as many digits as the text
    has room for: from one digit on, the first number of digits that its total has is the fixed point (a digit more
    adds one byte, so one is always found)."""
    for digits in range(1, 40):
        text = json.dumps({**(extra or {}), "files": files, "total_bytes": "#" * digits}, sort_keys=True, ensure_ascii=False).replace(f'"{"#" * digits}"', "#" * digits)
        total = sum(f["bytes"] for f in files) + len(text.encode())
        if len(str(total)) == digits:
            return text.replace("#" * digits, str(total))
    raise ValueError("no fixed point")


def size_gate(spark: SparkSession, folder: str, limit: int, name: str = "manifest.json") -> dict:
    """Writes the self-describing manifest of a folder (paths and sizes by Hadoop's listing, without the manifest itself) and
    returns total_bytes and whether it is within the limit. A package has tens of files, not a table's rows."""
    jvm, p, fs = _paths(spark, folder)
    remove(spark, f"{folder}/{name}")
    top = fs.makeQualified(p).toString().rstrip("/")
    listing, files = fs.listFiles(p, True), []
    while listing.hasNext():
        f = listing.next()
        files.append({"path": f.getPath().toString()[len(top) + 1 :], "bytes": f.getLen()})
    text = self_describing(sorted(files, key=lambda f: f["path"]))
    put_text(spark, f"{folder}/{name}", text)
    total = json.loads(text)["total_bytes"]
    return {"total_bytes": total, "limit": limit, "ok": total <= limit}
