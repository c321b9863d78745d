"""JSON and JSONL exports of posts: unwrapping, alias columns, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.ids import derived_id
from postmill.functions.number import duration_seconds, parse_count
from postmill.functions.text import categorise, first_text
from postmill.functions.time import parse_published

#: Keys that wrap a list of records, in the order in which they are looked for.
WRAPPERS = ("videos", "items", "aweme_list", "contents", "data", "result")
#: Paths of each field, the first that is neither null nor empty counts.
PATHS = {
    "video_id": ("aweme_id", "video_id", "note_id", "id"),
    "title": ("title", "desc", "caption"),
    "account_id": ("creator_hash", "sec_uid", "author.sec_uid", "author.uid", "user_id"),
    "account_name": ("nickname", "author.nickname", "account_name"),
    "url": ("aweme_url", "share_url", "url"),
    "published": ("create_time", "published_at", "publish_time"),
    "likes": ("liked_count", "digg_count", "statistics.digg_count"),
    "comments": ("comment_count", "statistics.comment_count"),
    "shares": ("share_count", "statistics.share_count"),
    "collects": ("collected_count", "collect_count", "statistics.collect_count"),
    "plays": ("play_count", "statistics.play_count"),
    "duration_ms": ("duration", "video.duration"),
    "duration_s": ("duration_seconds",),
    "keyword": ("source_keyword", "keyword"),
}
COUNTS = ("likes", "comments", "shares", "collects", "plays")


def infer_source(file: Column) -> Column:
    """What a file holds, by its name."""
    name = F.lower(F.substring_index(file, "/", -1))
    return F.when(name.rlike("hot|board"), "hotboard").when(name.rlike("search"), "search").otherwise("creator")


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(raw_file, position, record): one VARIANT a record. A .jsonl line that is no JSON is dropped; one cut inside a
    string is joined with the next lines first (five at most). A .json file may wrap its records several levels deep.
    Lines are read by split, many tasks a file; position orders a file's records (its numbers follow the splits)."""
    lines_of = [p for p in paths if p.endswith(".jsonl")]
    whole_of = [p for p in paths if not p.endswith(".jsonl")]
    parts = []
    if lines_of:
        parts.append(_line_records(spark, lines_of))
    if whole_of:
        t = spark.read.text(whole_of, wholetext=True).select(F.col("_metadata.file_path").alias("raw_file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
        start = F.struct(F.lit(0).cast("bigint").alias("split"), F.lit(0).cast("bigint").alias("line"))
        parts.append(t.select("raw_file", start.alias("position"), F.try_parse_json("text").alias("v")).filter("v is not null"))
    return unwrapped(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def _line_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(raw_file, position, v) of JSONL files. Only lines that don't parse are shuffled, with the edges of each split;
    whether two of them are neighbours shows from their numbers, over a split's edge from the splits' edges."""
    t = spark.read.option("lineSep", "\n").text(paths)
    t = t.select(F.col("_metadata.file_path").alias("raw_file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("text"))
    t = t.filter(F.trim("text") != "").withColumn("line", F.monotonically_increasing_id())
    place = F.struct("split", F.col("line").bitwiseAND(F.lit((1 << 33) - 1)).alias("line")).alias("position")
    read = t.withColumn("v", F.try_parse_json("text"))
    whole = read.filter("v is not null").select("raw_file", place, "v")
    edges = t.groupBy("raw_file", "split").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    edges = edges.withColumn("next", F.lead("split").over(Window.partitionBy("raw_file").orderBy("split")))  # a row a split
    broken = read.filter("v is null").select("raw_file", "split", "line", "text").join(edges, ["raw_file", "split"])
    joined = _rejoined(broken).select("raw_file", place, F.try_parse_json("text").alias("v"))
    return whole.unionByName(joined)


#: Fixed value: so many lines are joined to a cut one.
REJOINED = 5


def _rejoined(broken: DataFrame) -> DataFrame:
    """(raw_file, split, line, text): records put together from neighbouring broken lines, the fewest that parse. A record
    starts with a brace; what it took up starts none, nor do the five lines after a start that never parses."""
    w = Window.partitionBy("raw_file").orderBy("split", "line")
    same = (F.lag("split").over(w) == F.col("split")) & (F.lag("line").over(w) + 1 == F.col("line"))
    over = (F.lag("line").over(w) == F.lag("last").over(w)) & (F.lag("next").over(w) == F.col("split")) & (F.col("line") == F.col("first"))
    x = broken.withColumn("linked", F.coalesce(same | over, F.lit(False))).withColumn("opens", F.startswith("text", F.lit("{")))
    ahead = [F.struct(F.lead("linked", k).over(w).alias("linked"), F.lead("text", k).over(w).alias("text")).alias(f"a{k}") for k in range(1, REJOINED + 1)]
    x = x.select("raw_file", "split", "line", "text", "linked", "opens", *ahead)
    taken = F.lit(None).cast("int")
    for k in range(REJOINED, 0, -1):
        linked = F.lit(True)
        for j in range(1, k + 1):
            linked = linked & F.coalesce(F.col(f"a{j}.linked"), F.lit(False))
        text = F.concat_ws("\\n", "text", *[f"a{j}.text" for j in range(1, k + 1)])
        taken = F.when(linked & F.try_parse_json(F.when(linked, text)).isNotNull(), k).otherwise(taken)
    x = x.withColumn("taken", F.when(F.col("opens"), taken))
    tail = [F.when(F.col("taken") >= k, F.col(f"a{k}.text")) for k in range(1, REJOINED + 1)]
    x = x.select("raw_file", "split", "line", F.when(F.col("taken").isNotNull(), F.concat_ws("\\n", "text", *tail)).alias("text"), "linked", "opens", "taken")
    return x.mapInPandas(_starts, "raw_file string, split bigint, line bigint, text string")


def _starts(batches):
    """Walks broken lines in file order, with what is left to pass over as its only state."""
    file, over = None, 0
    for b in batches:
        keep = []
        for name, linked, opens, taken in zip(b.raw_file, b.linked, b.opens, b.taken):
            if name != file or not linked:
                file, over = name, 0
            begins = over == 0 and opens
            keep.append(begins and taken == taken and taken is not None)
            over = (int(taken) if keep[-1] else REJOINED) if begins else max(0, over - 1)
        yield b.loc[keep, ["raw_file", "split", "line", "text"]]


def unwrapped(raw: DataFrame) -> DataFrame:
    """Lists and wrapped lists to their records, three levels deep; anything else is a record itself."""
    for level in range(3):
        inner = F.coalesce(*[F.try_variant_get("v", f"$.{w}", "variant") for w in WRAPPERS])
        inner = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(inner)
        items = F.try_variant_get(inner, "$", "array<variant>")
        one = F.array(F.coalesce(inner, F.col("v")))
        raw = raw.select("raw_file", F.posexplode(F.coalesce(items, one)).alias(f"p{level}", "v"), *[c for c in raw.columns if c not in ("raw_file", "v")])
    places = F.struct("position", *[f"p{k}" for k in (0, 1, 2)])
    return raw.filter(F.schema_of_variant("v").startswith("OBJECT")).select("raw_file", places.alias("position"), F.col("v").alias("record"))


def _field(name: str) -> Column:
    return first_text(*[F.try_variant_get("record", "$." + p, "string") for p in PATHS[name]])


def normalise(raw: DataFrame, zone: str = "Asia/Shanghai", categories: list | None = None) -> DataFrame:
    """Records with the columns of schema.POST. Null metrics stay null and are named in missing."""
    x = raw.select(
        *[_field(c).alias(c) for c in PATHS if c not in COUNTS and c not in ("published", "duration_ms", "duration_s")],
        *[parse_count(_field(c)).alias(c) for c in COUNTS],
        parse_published(_field("published"), zone).alias("published"),
        duration_seconds(_field("duration_ms"), _field("duration_s")).alias("duration_seconds"),
        infer_source(F.col("raw_file")).alias("source"), "raw_file", "position",
    )
    from_url = F.nullif(F.regexp_extract("url", r"/(?:video|note)/([0-9]+)", 1), F.lit(""))
    derived = derived_id("derived-", 20, F.col("url"), F.col("title"), F.col("account_name"), F.date_format("published", "yyyy-MM-dd HH:mm:ss"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (*COUNTS, "published")]))
    return x.withColumn("video_id", F.coalesce("video_id", from_url, derived)).withColumn("missing", missing).withColumn("category", categorise(F.coalesce("title", F.lit("")), categories or []))


def first_seen(posts: DataFrame) -> DataFrame:
    """One row a video: the first in reading order."""
    w = Window.partitionBy("video_id").orderBy("raw_file", "position")
    return posts.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


#: Ours: a path is matched to the last so many characters of an id, then to all of it.
PIECE = 8


def with_hints(posts: DataFrame, hints: DataFrame) -> DataFrame:
    """Creator files whose path names an account (account_id, account_name) belong to it; of several accounts that a
    path names, to the one with the longest id (then the first). Paths are matched once each by a join of their pieces with
    the ends of ids, posts join by their file."""
    h = hints.select(F.col("account_id").alias("_id"), F.col("account_name").alias("_name")).filter("_id <> ''")
    h = h.withColumn("_low", F.lower("_id")).withColumn("_piece", F.right("_low", F.lit(PIECE)))
    files = posts.filter("source = 'creator'").select("raw_file").distinct().withColumn("_path", F.lower("raw_file"))

    def cut(n):  # all pieces of n characters
        last = F.length("_path") - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("_path"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = files.withColumn("_piece", F.explode(F.array_distinct(F.concat(*[cut(n) for n in range(1, PIECE + 1)]))))
    named = pieces.join(h, "_piece").filter(F.contains(F.col("_path"), F.col("_low")))
    named = named.groupBy("raw_file").agg(F.min_by(F.struct("_id", "_name"), F.struct(-F.length("_id"), "_id", "_name")).alias("_hint"))
    x = posts.join(named, "raw_file", "left").withColumn("_hint", F.when(F.col("source") == "creator", F.col("_hint")))
    return x.withColumn("account_id", F.coalesce("_hint._id", "account_id")).withColumn("account_name", F.coalesce("_hint._name", "account_name")).select(*posts.columns)


def newest(spark: SparkSession, folder: str, pattern: str = "*", most: int = 20) -> list[str]:
    """Paths of the newest files of a folder; only their metadata is read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return [r.path for r in f.orderBy(F.desc("modificationTime"), F.desc("path")).limit(most).collect()]
