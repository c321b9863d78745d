"""RSS, Atom and JSON feeds, and what can be saved of malformed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import plain_text
from postmill.functions.time import parse_feed_date
from postmill.functions.url import host


def _tag(block: Column, *names: str) -> Column:
    """The content of the first of these tags, whatever its namespace."""
    found = [F.nullif(plain_text(F.regexp_replace(F.regexp_extract(block, rf"(?is)<(?:\w+:)?{n}(?: [^>]*)?>(.*?)</(?:\w+:)?{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")) for n in names]
    return F.coalesce(*found)


def _link(block: Column) -> Column:
    return F.coalesce(_tag(block, "link"), F.nullif(F.regexp_extract(block, r'(?i)<(?:\w+:)?link [^>]*href="([^"]+)"', 1), F.lit("")))


def blocks(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row (block) for each whole entry of a feed's text."""
    return texts.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?(?:item|entry)(?: [^>]*)?>.*?</(?:\w+:)?(?:item|entry)>"), F.lit(0))).alias("block"))


def articles(blocks: DataFrame, block: str, source: Column, kind: Column, *keep: str) -> DataFrame:
    """Entry blocks to articles (schema.ARTICLE); an entry needs a title, a link and a date that can be read."""
    b = F.col(block)
    x = blocks.select(
        *keep, source.alias("source"), kind.alias("source_kind"), _tag(b, "title").alias("title"), _link(b).alias("url"), _tag(b, "description", "summary", "content").alias("summary"),
        parse_feed_date(_tag(b, "pubDate", "published", "updated", "date")).alias("published"),
    )
    return x.withColumn("domain", host(F.col("url"))).filter("title is not null and url is not null and published is not null")


def read_xml(spark: SparkSession, paths: list[str], source: str, kind: str = "media") -> DataFrame:
    """Articles of RSS items and Atom entries. Blocks are found by themselves, so a feed that is cut off or malformed
    elsewhere still gives its whole entries."""
    return articles(blocks(spark.read.text(paths, wholetext=True), "value"), "block", F.lit(source), F.lit(kind))


def read_json(spark: SparkSession, paths: list[str], source: str, kind: str = "media") -> DataFrame:
    """Articles of a JSON feed: a list, or its items."""
    return listed(spark.read.text(paths, wholetext=True), "value", F.lit(source), F.lit(kind))


def listed(texts: DataFrame, text: str, source: Column, kind: Column, *keep: str) -> DataFrame:
    """Articles of the texts of JSON feeds."""
    v = texts.select(*keep, source.alias("source"), kind.alias("source_kind"), F.try_parse_json(text).alias("v")).filter("v is not null")
    items = F.coalesce(F.try_variant_get("v", "$.items", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    g = lambda *p: F.coalesce(*[F.nullif(F.try_variant_get("i", f"$.{x}", "string"), F.lit("")) for x in p])
    x = v.select(*keep, "source", "source_kind", F.explode(items).alias("i")).select(
        *keep, "source", "source_kind", g("title").alias("title"), g("url", "link").alias("url"), plain_text(g("summary", "content_text", "description")).alias("summary"),
        parse_feed_date(g("date_published", "published", "pubDate")).alias("published"),
    )
    return x.withColumn("domain", host(F.col("url"))).filter("title is not null and url is not null and published is not null")


def split_publisher(df: DataFrame) -> DataFrame:
    """Aggregated headlines 'headline - publisher': the publisher becomes the source."""
    m = r"^(.+) - ([^-]{2,60})$"
    hit = F.col("title").rlike(m)
    return df.withColumn("source", F.when(hit, F.regexp_extract("title", m, 2)).otherwise(F.col("source"))).withColumn("title", F.when(hit, F.regexp_extract("title", m, 1)).otherwise(F.col("title")))


def read_all(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame | None, list[dict]]:
    """The union of all sources that can be read, and an error row for each that can't: one bad source stops no other.
    A source: name, kind, format (xml or json), paths."""
    out, errors = None, []
    for s in sources:
        try:
            x = (read_json if s.get("format") == "json" else read_xml)(spark, s["paths"], s["name"], s.get("kind", "media"))
            x.schema  # noqa: B018  a path that is missing shows here
            out = x if out is None else out.unionByName(x)
        except Exception as e:  # noqa: BLE001  the source's failure is a row of the result
            errors.append({"source": s["name"], "error": type(e).__name__})
    return out, errors


def image_candidates(spark: SparkSession, paths: list[str], most: int = 8) -> DataFrame:
    """(link, url, kind, place): pictures of feed entries: media tags, then enclosures of an image type, then pictures in
    the entry's HTML; each URL once an entry, at most `most`."""
    return pictures(blocks(spark.read.text(paths, wholetext=True), "value"), [], most)


def pictures(blocks: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """image_candidates of entry blocks, for each of the keys apart."""
    b = F.col("block")
    plain = F.replace(F.replace(F.replace(b, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"'))
    found = {
        "media": F.regexp_extract_all(b, F.lit(r'(?i)<media:(?:content|thumbnail) [^>]*url="([^"]+)"'), F.lit(1)),
        "enclosure": F.regexp_extract_all(b, F.lit(r'(?i)<enclosure (?=[^>]*type="image/)[^>]*url="([^"]+)"'), F.lit(1)),
        "embedded": F.regexp_extract_all(plain, F.lit(r'(?i)<img [^>]*src="([^"]+)"'), F.lit(1)),
    }

    def tagged(rank, kind, urls):
        return F.transform(urls, lambda u, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.lit(kind).alias("kind"), u.alias("url")))

    x = blocks.select(*keys, _link(b).alias("link"), F.explode(F.flatten(F.array(*[tagged(r, k, v) for r, (k, v) in enumerate(found.items())]))).alias("c")).select(*keys, "link", "c.*")
    x = x.filter("link is not null").groupBy(*keys, "link", "url").agg(F.min(F.struct("rank", "i", "kind")).alias("c")).select(*keys, "link", "url", "c.rank", "c.i", "c.kind")
    from postmill.operators.select import top

    return top(x, [*keys, "link"], most, F.asc("rank"), F.asc("i"), keep_rank="_at").select(*keys, "link", "url", "kind", F.col("_at").alias("nth" if "place" in keys else "place"))
