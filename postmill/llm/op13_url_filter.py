"""URL filters in Spark SQL functions only: host and path rules, and a list of URLs behind a blocked Bloom filter.

A listed URL is canonical: its host in lower case without `www.` and the scheme's own port, and its path without the
slashes at its end; scheme, query and fragment don't count. The filter has blocks of 256 bits, as four longs a row. A
URL's 64-bit hash names its block, a second one sets two bits in each of the four longs (twelve bits of hash a long). So
a page looks up one row and compares four longs: possible hits alone go on to an exact join with the list, which removes
the false ones.

The filter has a row for 16 listed URLs. Up to MAX_BLOCKS rows it is broadcast; beyond that it is joined by block, where
pages that need no look-up carry keys of their own, so that they don't meet in one task. The list is broadcast up to
MAX_EXACT rows; beyond that only possible hits are shuffled to it. A page's own row is never grouped or
repeated, so a hot URL is a skewed side of a plain join, which Spark splits.

A rule fits its host and all hosts below it if the path starts with the rule's. Of several that fit the longest (host and
path together) decides, whatever the list says; among rules of one length the first in the order of its text. Rules are a
setting, of which each is a condition; a long list of hosts belongs in the URL list's place.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule, is not listed, and is allowed.
An empty path starts with no rule's path. Listed entries that are null or no URLs are passed over, repeated ones count once, an
empty list blocks nothing. Repeated rows and page_ids, null ones too, each keep their row. Extra columns are not read; an
empty table gives no rows. A URL may be as long as a Spark string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Sites whose pages make the query's list.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
WORDS, KEYS_A_BLOCK = 4, 16
MAX_BLOCKS, MAX_EXACT, APART = 1 << 20, 1 << 20, 4096


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path: what follows the first ://, up to its own end."""
    x = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    x = x.withColumn("_at", F.expr("coalesce(instr(url, '://'), 0)")).withColumn("_rest", F.expr("case when _at > 0 then substring(url, _at + 3) else '' end"))
    x = x.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return x.select("page_id", "url", F.translate("_host", UPPER, LOWER).alias("host"), path.alias("path"))


def canonical(url: str = "url", host: str = "host", path: str = "path") -> Column:
    """The URL as it is listed; null for what is no URL."""
    secure = F.lower(F.substring(url, 1, 5)) == "https"
    port = F.when(secure, F.regexp_replace(host, r":443\z", "")).otherwise(F.regexp_replace(host, r":80\z", ""))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(F.regexp_replace(port, r"^www\.", ""), F.regexp_replace(path, r"/+\z", "")))


def rule(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(sorted(rules, key=lambda r: r[1] + r[2], reverse=True), key=lambda r: len(r[1] + r[2])):  # the last decides
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint"))


def masks(key: str) -> list[Column]:
    """Four longs with the two bits that the key sets in each."""
    bit = lambda k: f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * k}) & 63L as int))"
    return [F.expr(f"{bit(2 * w)} | {bit(2 * w + 1)}") for w in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """_block, _w0 .. _w3 of a table with one column of keys. Keys are hashes by block, so no block is hot; bits are summed before they are shuffled."""
    (key,) = keys.columns
    x = keys.select(block_of(F.col(key), blocks).alias("_block"), *[m.alias(f"_w{w}") for w, m in enumerate(masks(key))])
    return x.groupBy("_block").agg(*[F.bit_or(f"_w{w}").alias(f"_w{w}") for w in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, keys_a_block: int = KEYS_A_BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict, possible (the filter's answer), listed. listed: a table with a column `url`."""
    listed = parts(listed.select(F.lit(None).cast("bigint").alias("page_id"), "url"))
    listed = saved(listed.select(canonical().alias("_listed")).filter("_listed is not null").distinct(), "listed")
    n = listed.count()
    blocks = max(1, -(-n // keys_a_block))
    small = blocks <= MAX_BLOCKS
    bits = bloom(listed, blocks)

    x = parts(pages).withColumn("_r", rule(rules)).withColumn("_key", F.when(F.col("_r").isNull(), canonical()))
    key = block_of(F.col("_key"), blocks)
    apart = F.lit(None) if small else -1 - F.pmod(F.xxhash64("page_id", "url"), F.lit(APART).cast("bigint"))
    x = x.withColumn("_block", F.when(F.col("_key").isNotNull(), key).otherwise(apart)).join(F.broadcast(bits) if small else bits, "_block", "left")
    hit = F.col("_block").isNotNull() & F.col("_key").isNotNull()
    for w, m in enumerate(masks("_key")):
        hit = hit & (F.coalesce(F.col(f"_w{w}"), F.lit(0).cast("bigint")).bitwiseAND(m) == m)
    x = x.select("page_id", "host", "path", "_r", "_key", F.coalesce(hit, F.lit(False)).alias("possible"))
    exact = listed.withColumn("listed", F.lit(True))
    if n <= MAX_EXACT:
        x = x.join(F.broadcast(exact), F.col("possible") & (F.col("_key") == F.col("_listed")), "left")
    else:  # what the filter stops isn't shuffled
        hits = x.filter("possible").join(exact, F.col("_key") == F.col("_listed"), "left")
        x = hits.unionByName(x.filter("not possible").withColumns({"_listed": F.lit(None).cast("string"), "listed": F.lit(False)}))
    found = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("_r.verdict", F.when(found, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "possible", found.alias("listed"))


def listed_pages(pages: DataFrame, sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """The URLs of all pages of some sites: the query's list, which grows with the table."""
    label = F.split("host", r"\.")
    return parts(pages).filter(F.arrays_overlap(label, F.array(*map(F.lit, sites)))).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_pages(pages)).drop("possible")


#: The query in DuckDB SQL: the list by an exact semi-join.
SQL = r"""
with a as (select page_id, url, coalesce(instr(url, '://'), 0) as pos from pages),
b as (select page_id, url, case when pos > 0 then substr(url, pos + 3) else '' end as rest, pos from a),
c as (select *, regexp_extract(rest, '^[^/?#]*') as h from b),
d as (select page_id, url, pos, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from c),
e as (select *, case when pos > 0 then regexp_replace(case when lower(substr(url, 1, 5)) = 'https' then regexp_replace(host, ':443\z', '') else regexp_replace(host, ':80\z', '') end, '^www\.', '') || regexp_replace(path, '/+\z', '') end as key from d),
l as (select distinct key from e where list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) and key is not null),
r as (select e.*, case when host = 'example.com' or ends_with(host, '.example.com') then starts_with(path, '/de/') else false end as com,
    (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') as net_en, (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') as net, (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') as org from e)
select page_id, host, path, case when com then 'example.com/de/' when net_en then 'example.net/en/' when org then 'org/fr/' when net then 'net/' end as rule,
  case when com then 'block' when net_en then 'allow' when org then 'allow' when net then 'block' when l.key is not null then 'block' else 'allow' end as verdict,
  not (com or net_en or org or net) and l.key is not null as listed
from r left join l on r.key = l.key"""
