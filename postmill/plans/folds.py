"""Queries whose rows depend on what was taken before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.ids import sign_bits
from postmill.functions.text import numbers, pairs_of_characters, title_key, tokens, words
from postmill.operators import folds, stories
from postmill.operators.rounds import first_of_marks
from postmill.plans.registry import query
from postmill.sources.tables import ARTICLES_SQL, POSTS_SQL, articles, posts, table

_KEY = "case when regexp_replace(lower(title), '[^\\p{L}\\p{N}_]', '', 'g') = '' then '' else substr(sha256(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]', '', 'g')), 1, 20) end"



def first_fit_sql(rows: str, hit: str) -> str:
    """SQL of a loop over each source's rows, which carries the sets (t) of the clusters' first rows. hit: a place in f.heads, or null."""
    return f"""
k as (select *, row_number() over (partition by source order by doc_id) as rn from ({rows})),
f as (select source, rn, doc_id, 0 as cluster, [t] as heads from k where rn = 1
  union all select source, rn, doc_id, coalesce(pos - 1, len(heads)), case when pos is null then list_append(heads, t) else heads end from (select k.source, k.rn, k.doc_id, k.t, f.heads, {hit} as pos from f join k on k.source = f.source and k.rn = f.rn + 1))
select doc_id, source, cast(cluster as int) as cluster from f"""


_COMMON = "len(list_intersect(h, k.t))"
_SHARE = f"{_COMMON} / greatest(1, least(len(h), len(k.t)))"


def first_like(least: int, share: float) -> str:
    """The first cluster with so many shared members and such a share of the smaller set."""
    return f"nullif(list_position(list_transform(f.heads, lambda h: {_COMMON} >= {least} and {_SHARE} >= {share}), true), 0)"


_MOST_LIKE = f"case when list_max(list_transform(f.heads, lambda h: {_SHARE})) >= 0.55 then list_position(list_transform(f.heads, lambda h: {_SHARE}), list_max(list_transform(f.heads, lambda h: {_SHARE}))) end"
_PAIRS = "select doc_id, source, list_distinct(list_transform(generate_series(1, length(a) - 1), lambda i: a[i : i + 1])) as t from (select doc_id, source, regexp_replace(lower(substr(title, 1, 180)), '[^0-9a-z一-鿿]', '', 'g') as a from articles)"


def _title():
    """Titles are cut at 180 characters, as events show them."""
    return F.substring("title", 1, 180)


@query(f"""
with recursive {ARTICLES_SQL}, k as (select doc_id, lang, source || ':' || (n_chars // 40) as mark_a, {_KEY} as mark_b, lang || (doc_id % 97) as mark_c, row_number() over (partition by lang order by n_chars desc, doc_id) as rn from articles),
f as (select lang, rn, doc_id, true as accepted, [mark_a] as a, [mark_b] as b, [mark_c] as c from k where rn = 1
  union all select k.lang, k.rn, k.doc_id, not (list_contains(f.a, k.mark_a) or list_contains(f.b, k.mark_b) or list_contains(f.c, k.mark_c)),
    case when list_contains(f.a, k.mark_a) or list_contains(f.b, k.mark_b) or list_contains(f.c, k.mark_c) then f.a else list_append(f.a, k.mark_a) end,
    case when list_contains(f.a, k.mark_a) or list_contains(f.b, k.mark_b) or list_contains(f.c, k.mark_c) then f.b else list_append(f.b, k.mark_b) end,
    case when list_contains(f.a, k.mark_a) or list_contains(f.b, k.mark_b) or list_contains(f.c, k.mark_c) then f.c else list_append(f.c, k.mark_c) end
  from f join k on k.lang = f.lang and k.rn = f.rn + 1)
select doc_id, lang, accepted from f""")
def multi_key_dedup(spark, sf_dir):
    """A row goes if any of three keys was registered by an accepted row; dropped rows register nothing."""
    k = articles(spark, sf_dir).select(
        "doc_id", "lang", "n_chars", F.concat_ws(":", "source", F.floor(F.col("n_chars") / 40)).alias("mark_a"), title_key(F.col("title")).alias("mark_b"), F.concat("lang", F.col("doc_id") % 97).alias("mark_c")
    )
    x = first_of_marks(k, ["lang"], [("n_chars", False), ("doc_id", True)], ["mark_a", "mark_b", "mark_c"], "doc_id")
    return x.select("doc_id", "lang", F.col("duplicate_of").isNull().alias("accepted"))


@query(f"""
with recursive {POSTS_SQL}, k as (select event_id, day, cast(round(value * 100) as bigint) as size, event_id % 7 <> 0 as usable, row_number() over (partition by day order by value desc, event_id) as rn from posts),
f as (select day, rn, event_id, case when size > 40000 then 'oversize' when usable then 'delivered' else 'unusable' end as outcome, case when size <= 40000 and usable then 1 else 0 end as n,
    case when size <= 40000 and usable then size else 0 end as delivered_bytes, case when size <= 40000 then size else 0 end as transferred_bytes from k where rn = 1
  union all select k.day, k.rn, k.event_id, case when f.n >= 40 or 150000 - greatest(f.delivered_bytes, f.transferred_bytes) <= 0 then 'not_reached' when k.size > least(40000, 150000 - greatest(f.delivered_bytes, f.transferred_bytes)) then 'oversize' when k.usable then 'delivered' else 'unusable' end,
    f.n + case when f.n >= 40 or k.size > least(40000, 150000 - greatest(f.delivered_bytes, f.transferred_bytes)) or 150000 - greatest(f.delivered_bytes, f.transferred_bytes) <= 0 or not k.usable then 0 else 1 end,
    f.delivered_bytes + case when f.n >= 40 or k.size > least(40000, 150000 - greatest(f.delivered_bytes, f.transferred_bytes)) or 150000 - greatest(f.delivered_bytes, f.transferred_bytes) <= 0 or not k.usable then 0 else k.size end,
    f.transferred_bytes + case when f.n >= 40 or k.size > least(40000, 150000 - greatest(f.delivered_bytes, f.transferred_bytes)) or 150000 - greatest(f.delivered_bytes, f.transferred_bytes) <= 0 then 0 else k.size end
  from f join k on k.day = f.day and k.rn = f.rn + 1)
select event_id, day, outcome, cast(delivered_bytes as bigint) as delivered_bytes, cast(transferred_bytes as bigint) as transferred_bytes from f""")
def download_budget_fold(spark, sf_dir):
    """Downloads of each day under item, byte and count caps with two ledgers."""
    k = posts(spark, sf_dir).select("event_id", "day", "value", F.round(F.col("value") * 100).cast("bigint").alias("size"), (F.col("event_id") % 7 != 0).alias("usable"))
    x = folds.download_budget(k, ["day"], [("value", False), ("event_id", True)], "size", "usable", 40, 150_000, 40_000)
    return x.select("event_id", "day", "outcome", "delivered_bytes", "transferred_bytes")


@query("""
with recursive k as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as rn from conversations),
f as (select conv_id, turn, rn, 0 as chunk, n + 1 as used from k where rn = 1
  union all select k.conv_id, k.turn, k.rn, case when f.used + k.n + 1 > 600 then f.chunk + 1 else f.chunk end, case when f.used + k.n + 1 > 600 then k.n + 1 else f.used + k.n + 1 end from f join k on k.conv_id = f.conv_id and k.rn = f.rn + 1)
select conv_id, turn, chunk from f""")
def transcript_chunks(spark, sf_dir):
    """Transcript lines to chunks of 600 characters."""
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return folds.text_chunks(k, ["conv_id"], [("turn", True)], "n", 600).select("conv_id", "turn", "chunk")


@query("""
with recursive k as (select p_partkey, p_type, cast(round(p_retailprice) as bigint) as size, p_brand, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rn from part),
f as (select p_type, rn, p_partkey, 'taken' as stage, 1 as taken, size as total, [p_brand] as used from k where rn = 1
  union all select k.p_type, k.rn, k.p_partkey,
    case when f.taken >= 6 and f.total >= 6000 then 'stopped' when list_contains(f.used, k.p_brand) then 'author' when f.total + k.size > 12000 then 'ceiling' else 'taken' end,
    f.taken + case when f.taken >= 6 and f.total >= 6000 then 0 when list_contains(f.used, k.p_brand) then 0 when f.total + k.size > 12000 then 0 else 1 end,
    f.total + case when f.taken >= 6 and f.total >= 6000 then 0 when list_contains(f.used, k.p_brand) then 0 when f.total + k.size > 12000 then 0 else k.size end,
    case when f.taken >= 6 and f.total >= 6000 then f.used when list_contains(f.used, k.p_brand) then f.used when f.total + k.size > 12000 then f.used else list_append(f.used, k.p_brand) end
  from f join k on k.p_type = f.p_type and k.rn = f.rn + 1)
select p_partkey, p_type, stage from f""")
def material_quota_fold(spark, sf_dir):
    """Materials under a target, a byte floor and ceiling, one of an author."""
    k = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice", F.round("p_retailprice").cast("bigint").alias("size"))
    return folds.material_quota(k, ["p_type"], [("p_retailprice", False), ("p_partkey", True)], "size", "p_brand", 6, 6000, 12_000, 1).select("p_partkey", "p_type", "stage")


@query(f"""
with recursive {POSTS_SQL}, k as (select event_id, account_id, epoch_us(published) as t, row_number() over (partition by account_id order by published, event_id) as rn from posts),
f as (select account_id, rn, event_id, t as head, 0 as frame from k where rn = 1
  union all select k.account_id, k.rn, k.event_id, case when k.t - f.head > 7200000000 then k.t else f.head end, case when k.t - f.head > 7200000000 then f.frame + 1 else f.frame end from f join k on k.account_id = f.account_id and k.rn = f.rn + 1)
select event_id, account_id, frame from f""")
def frame_merge(spark, sf_dir):
    """Posts within two hours of the first of their group are one."""
    k = posts(spark, sf_dir).select("event_id", "account_id", F.unix_micros(F.col("published").cast("timestamp")).alias("t"))
    return folds.merge_frames(k, ["account_id"], [("t", True), ("event_id", True)], "t", 7_200_000_000).select("event_id", "account_id", "frame")


@query()
def greedy_token_clusters(spark, sf_dir):
    """Titles to growing token clusters, by source."""
    k = articles(spark, sf_dir).select("doc_id", "source", tokens(_title()).alias("tokens"))
    return folds.token_clusters(k, ["source"], [("doc_id", True)], "tokens").select("doc_id", "source", "cluster")


@query(f"with recursive {ARTICLES_SQL}, {first_fit_sql(_PAIRS, _MOST_LIKE)}")
def article_clusters(spark, sf_dir):
    """Articles to the event with the most similar first title, by source."""
    k = articles(spark, sf_dir).select("doc_id", "source", pairs_of_characters(_title()).alias("pairs"))
    return folds.best_title_clusters(k, ["source"], [("doc_id", True)], "pairs").select("doc_id", "source", "cluster")


@query()
def story_clusters(spark, sf_dir):
    """Stories by named anchors and text, which don't chain."""
    w = words(_title())
    k = articles(spark, sf_dir).select(
        "doc_id", "source", F.substring(F.regexp_replace(F.lower(_title()), r"[^\p{L}\p{N}]", ""), 1, 1000).alias("text"), F.array_distinct(F.filter(w, lambda x: x.rlike("[0-9]"))).alias("models"),
        F.array_distinct(F.filter(w, lambda x: F.length(x) >= 14)).alias("subjects"), F.array().cast("array<string>").alias("entities"), F.array_distinct(numbers(_title())).alias("dates"), F.array_distinct(w).alias("tokens"),
    )
    return stories.story_clusters(k, ["source"], "doc_id").select("doc_id", "source", "cluster")


@query()
def card_merge(spark, sf_dir):
    """Texts of a conversation's turns to cards."""
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t"), F.array_distinct(numbers(F.col("text"))).alias("numbers"))
    return folds.merge_cards(k, ["conv_id"], [("turn", True)], "t", "numbers").select("conv_id", "turn", "card", "card_text")


@query("""
with recursive h as (select vec_id, label, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as bits, row_number() over (partition by label order by vec_id) as rn from embeddings),
f as (select label, rn, vec_id, true as accepted, [bits] as taken from h where rn = 1
  union all select h.label, h.rn, h.vec_id, not list_bool_or(list_transform(f.taken, lambda t: hamming(t, h.bits) <= 4)),
    case when list_bool_or(list_transform(f.taken, lambda t: hamming(t, h.bits) <= 4)) then f.taken else list_append(f.taken, h.bits) end from f join h on h.label = f.label and h.rn = f.rn + 1)
select vec_id, label, accepted from f""")
def near_dup_keep_first(spark, sf_dir):
    """Hashes of a label in order, those within 4 bits of one kept left out."""
    k = table(spark, sf_dir, "embeddings").select("vec_id", "label", sign_bits(F.col("embedding")).alias("bits"))
    x = folds.drop_near_hashes(k, ["label"], [("vec_id", True)], "bits", 4)
    return x.select("vec_id", "label", F.col("pick").isNotNull().alias("accepted"))


@query("""
with recursive h as (select vec_id, label, vec_id % 5 as scene, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as bits from embeddings),
f as (select distinct label, 0 as n, cast(null as bigint) as vec_id, cast(null as bigint) as scene, cast([] as struct(vec_id bigint, scene bigint, bits varchar)[]) as taken from h
  union all select label, n, vec_id, scene, list_append(taken, {'vec_id': vec_id, 'scene': scene, 'bits': bits}) from (
    select h.label, f.n + 1 as n, h.vec_id, h.scene, h.bits, f.taken from f join h on h.label = f.label where f.n < 8 and not coalesce(list_bool_or(list_transform(f.taken, lambda t: t.vec_id = h.vec_id or hamming(t.bits, h.bits) <= 4)), false)
    qualify row_number() over (partition by h.label order by coalesce(list_bool_or(list_transform(f.taken, lambda t: t.scene = h.scene)), false), h.vec_id) = 1))
select vec_id, label, scene, cast(n - 1 as int) as pick from f where n > 0""")
def diverse_pick(spark, sf_dir):
    """Eight pictures of each label, of new scenes first."""
    k = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5).alias("scene"), sign_bits(F.col("embedding")).alias("bits"))
    return folds.drop_near_hashes(k, ["label"], [("vec_id", True)], "bits", 4, 8, "scene").filter("pick is not null").select("vec_id", "label", "scene", "pick")


@query("""
with recursive k as (select p_partkey, p_brand as author, p_type as source, p_partkey % 40 as pool, cast(p_size as double) as seconds, p_retailprice as price from part),
f as (select distinct pool, 0 as n, cast([] as struct(id bigint, author varchar, source varchar, seconds double)[]) as taken from k
  union all select pool, n, list_append(taken, {'id': p_partkey, 'author': author, 'source': source, 'seconds': seconds}) from (
    select k.*, f.n + 1 as n, f.taken, coalesce(list_bool_or(list_transform(f.taken, lambda t: t.source = k.source)), false) as old, coalesce(list_bool_or(list_transform(f.taken, lambda t: t.seconds >= 30)), false) as long
    from f join k on k.pool = f.pool where f.n < 2 and not coalesce(list_bool_or(list_transform(f.taken, lambda t: t.author = k.author)), false) and (k.seconds >= 30 or not coalesce(list_bool_or(list_transform(f.taken, lambda t: t.seconds >= 30)), false))
    qualify row_number() over (partition by k.pool order by k.seconds < 30, k.seconds >= 30 and old, k.price desc, k.p_partkey) = 1)),
m as (select unnest(list_transform(taken, lambda t: t.id)) as p_partkey from f)
select p_partkey, pool, case when p_partkey in (select p_partkey from m) then 'main' else 'support' end as role from k""")
def main_support_split(spark, sf_dir):
    """Mains and supporting clips of each pool."""
    k = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.col("p_brand").alias("author"), F.col("p_type").alias("source"), (F.col("p_partkey") % 40).alias("pool"), F.col("p_size").cast("double").alias("seconds"))
    return folds.main_and_support(k, ["pool"], [("p_retailprice", False), ("p_partkey", True)], "author", "source", "seconds", 30.0).select("p_partkey", "pool", "role")
