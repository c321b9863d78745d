"""Jobs in resumable stages: the themed selection of materials, and the day's pool of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import has_any, hits, pairs_of_characters, title_key, tokens
from postmill.functions.url import canonical
from postmill.operators import folds, scores
from postmill.operators.joins import token_overlap
from postmill.operators.rounds import first_of_marks
from postmill.operators.select import audit, first_reason, top
from postmill.plans.registry import query
from postmill.plans.stages import Stages
from postmill.sinks.scratch import scratch
from postmill.sources.tables import ARTICLES_SQL, articles


# --- themed selection ------------------------------------------------------------------------------------------------


def gated(rows: DataFrame, exclude: Sequence[str], media: Sequence[str], least_seconds: float, most_seconds: float, least_heat: float) -> DataFrame:
    """Adds reason: the first gate that stops a candidate (id, title, media, seconds, heat); an unknown duration passes."""
    reason = first_reason(
        (has_any(F.col("title"), list(exclude)), "excluded_term"),
        (~F.col("media").isin(*media), "media_type"),
        ((F.col("seconds") < least_seconds) | (F.col("seconds") > most_seconds), "duration"),
        (F.col("heat") < least_heat, "heat"),
    )
    return rows.withColumn("reason", reason)


def ranked_for(rows: DataFrame, delivered: DataFrame, terms: Sequence[str], least_hits: int, pool_size: int) -> DataFrame:
    """Of those that passed: not delivered before, with enough of the theme; by hits, heat, id; the first pool_size."""
    fresh = rows.filter("reason is null").drop("reason").join(delivered.select("id").distinct(), "id", "left_anti")
    x = fresh.withColumn("theme_hits", hits(F.col("title"), list(terms))).filter(F.col("theme_hits") >= least_hits)
    return x.orderBy(F.desc("theme_hits"), F.desc("heat"), F.asc("id")).limit(pool_size)


def filled(pool: DataFrame, target: int, floor: int, ceiling: int, per_author: int) -> DataFrame:
    """Adds stage (taken, author, ceiling, stopped) and, of those taken, role (main, support). The pool has pool_size rows."""
    order = [("theme_hits", False), ("heat", False), ("id", True)]
    one = pool.withColumn("_run", F.lit(1))
    taken = folds.material_quota(one, ["_run"], order, "size", "author", target, floor, ceiling, per_author)
    mains = folds.main_and_support(taken.filter("stage = 'taken'"), ["_run"], order, "author", "source", "seconds", 30.0).select("id", "role")
    return taken.join(mains, "id", "left").drop("_run")


def themed_selection(spark: SparkSession, candidates: DataFrame, delivered: DataFrame, root: str, terms: Sequence[str], gates: dict | None = None, pool: dict | None = None, quota: dict | None = None) -> dict:
    """Candidates (id, title, author, source, media, seconds, size, heat) to a theme's selection: gates, pool, quota with
    mains and support, and an audit of all that was left out (one row a reason). Results are kept below root by content."""
    s = Stages(spark, root)
    gates = {"exclude": [], "media": ["video"], "least_seconds": 0.0, "most_seconds": 1e9, "least_heat": 0.0} | (gates or {})
    pool = {"terms": list(terms), "least_hits": 1, "pool_size": 62} | (pool or {})
    quota = {"target": 9, "floor": 0, "ceiling": 1 << 40, "per_author": 2} | (quota or {})
    source = s.source("candidates", candidates)
    passed = s.run("gates", [source], gated, gates)
    chosen = s.run("pool", [passed, s.source("delivered", delivered)], ranked_for, pool)
    done = s.run("selection", [chosen], filled, quota)

    def counted(all_rows, in_pool, selected):
        late = all_rows.filter("reason is null").join(in_pool.select("id"), "id", "left_anti").select(F.lit("not_in_pool").alias("reason"))
        stopped = selected.select(F.when(F.col("stage") == "taken", F.lit("selected")).otherwise(F.concat(F.lit("quota_"), "stage")).alias("reason"))
        return audit(all_rows.filter("reason is not null").select("reason").unionByName(late).unionByName(stopped))

    left = s.run("audit", [passed, chosen, done], counted)
    return {"selection": done.rows, "audit": left.rows, "log": s.log}


# --- the day's pool --------------------------------------------------------------------------------------------------


def of_day(posts: DataFrame, day: str) -> DataFrame:
    """Posts with the reason that keeps them out of the day."""
    t = F.col("published")
    return posts.withColumn("reason", first_reason((F.col("title").isNull() | F.col("url").isNull(), "no_title_or_link"), (t.isNull(), "no_publish_time"), (F.to_date(t) != F.lit(day).cast("date"), "outside_day")))


def distinct_posts(posts: DataFrame) -> DataFrame:
    """The day's posts, by engagement, with duplicate_of: an id, a URL or a title was taken by one before."""
    x = posts.filter("reason is null").drop("reason").withColumn("engagement", scores.engagement())
    x = x.withColumns({"_url": canonical(F.col("url")), "_title": title_key(F.col("title")), "_id": F.xxhash64("video_id")})
    return first_of_marks(x, [], [("engagement", False), ("video_id", True)], ["video_id", "_url", "_title"], "_id").drop("_url", "_title", "_id")


def official_events(news: DataFrame, day: str) -> DataFrame:
    """The day's articles to events: title, number of articles and domains, whether a primary source has it."""
    a = news.filter(F.to_date("published") == F.lit(day).cast("date")).withColumn("day", F.to_date("published")).withColumn("pairs", pairs_of_characters(F.col("title")))
    a = folds.best_title_clusters(a, ["day"], [("published", True), ("url", True)], "pairs")
    place = F.struct("published", "url")
    e = a.groupBy("cluster").agg(F.min_by("title", place).alias("title"), F.count("*").alias("n_articles"), F.countDistinct(F.coalesce("domain", "source")).alias("n_domains"), F.bool_or(F.col("source_kind").isin("official", "primary")).alias("is_primary"))
    return e.withColumnRenamed("cluster", "event")


def pooled(events: DataFrame, posts: DataFrame, max_events: int, per_event: int) -> DataFrame:
    """Events with the posts that share most tokens with them, ranked: confirmed first, then engagement, articles, event."""
    p = posts.filter("duplicate_of is null").withColumn("tokens", tokens(F.col("title")))
    near = token_overlap(events.select("event", tokens(F.col("title")).alias("tokens")), p.select("video_id", "tokens"), "event", "video_id")
    near = top(near.join(p.select("video_id", "engagement"), "video_id"), ["event"], per_event, F.desc("n_shared"), F.desc("engagement"), F.asc("video_id"))
    heat = near.groupBy("event").agg(F.sum("engagement").alias("engagement"), F.array_sort(F.collect_list("video_id")).alias("videos"))
    x = events.join(heat, "event", "left").withColumn("confirmed", F.col("is_primary") | (F.col("n_domains") >= 2))
    x = x.withColumns({"engagement": F.coalesce("engagement", F.lit(0.0)), "videos": F.coalesce("videos", F.array().cast("array<string>"))})
    return x.orderBy(F.desc("confirmed"), F.desc("engagement"), F.desc("n_articles"), F.asc("event")).limit(max_events)


def daily_pool(spark: SparkSession, posts: DataFrame, news: DataFrame, day: str, root: str, max_events: int = 20, per_event: int = 5) -> dict:
    """Posts (schema.POST) and articles (schema.ARTICLE) to the day's pool of events with their videos, and an audit of
    the posts. Results are kept below root by content."""
    s = Stages(spark, root)
    dated = s.run("dated", [s.source("posts", posts)], of_day, {"day": day})
    unique = s.run("unique", [dated], distinct_posts)
    events = s.run("events", [s.source("articles", news)], official_events, {"day": day})
    pool = s.run("pool", [events, unique], pooled, {"max_events": max_events, "per_event": per_event})

    def counted(all_rows, once, chosen):
        used = chosen.select(F.explode("videos").alias("video_id")).distinct()
        good = once.filter("duplicate_of is null").join(used.withColumn("_used", F.lit(True)), "video_id", "left")
        reason = lambda x, r: x.select(r.alias("reason"))
        return audit(reason(all_rows.filter("reason is not null"), F.col("reason")).unionByName(reason(once.filter("duplicate_of is not null"), F.lit("duplicate"))).unionByName(reason(good, F.when(F.col("_used"), "in_an_event").otherwise("no_event"))))

    left = s.run("audit", [dated, unique, pool], counted)
    return {"pool": pool.rows, "audit": left.rows, "log": s.log}


# --- queries ---------------------------------------------------------------------------------------------------------

_THEME, _EXCLUDE = ("the", "der", "que", "les"), ("###", "%%%")
_HITS = " + ".join(f"(contains(lower(title), '{t}'))::int" for t in _THEME)


@query(f"""
with recursive {ARTICLES_SQL},
g as (select doc_id, lower(title) as l, title, source, lang, n_chars, n_chars / 15.0 as seconds from articles),
r as (select *, case when contains(l, '###') or contains(l, '%%%') then 'excluded_term' when lang not in ('en', 'de', 'fr') then 'media_type' when seconds < 20 or seconds > 600 then 'duration' when n_chars < 400 then 'heat' end as reason, {_HITS} as theme_hits from g),
p as (select *, row_number() over (order by theme_hits desc, n_chars desc, doc_id) as rn from (select * from r where reason is null and theme_hits >= 1 order by theme_hits desc, n_chars desc, doc_id limit 62)),
f as (select rn, doc_id, source, seconds, 'taken' as stage, 1 as taken, n_chars as total, [source] as used from p where rn = 1
  union all select p.rn, p.doc_id, p.source, p.seconds,
    case when f.taken >= 9 and f.total >= 20000 then 'stopped' when len(list_filter(f.used, lambda u: u = p.source)) >= 2 then 'author' when f.total + p.n_chars > 60000 then 'ceiling' else 'taken' end,
    f.taken + case when f.taken >= 9 and f.total >= 20000 or len(list_filter(f.used, lambda u: u = p.source)) >= 2 or f.total + p.n_chars > 60000 then 0 else 1 end,
    f.total + case when f.taken >= 9 and f.total >= 20000 or len(list_filter(f.used, lambda u: u = p.source)) >= 2 or f.total + p.n_chars > 60000 then 0 else p.n_chars end,
    case when f.taken >= 9 and f.total >= 20000 or len(list_filter(f.used, lambda u: u = p.source)) >= 2 or f.total + p.n_chars > 60000 then f.used else list_append(f.used, p.source) end
  from f join p on p.rn = f.rn + 1)
select reason, count(*) as n from (
  select reason from r where reason is not null union all select 'not_in_pool' from r where reason is null and doc_id not in (select doc_id from p)
  union all select case stage when 'taken' then 'selected' else 'quota_' || stage end from f) group by 1""")
def themed_selection_audit(spark, sf_dir):
    """What became of all documents as candidates of one theme, by the job's stages."""
    c = articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", F.col("source").alias("author"), "source", F.col("lang").alias("media"), (F.col("n_chars") / 15.0).cast("double").alias("seconds"), F.col("n_chars").alias("size"), F.col("n_chars").cast("double").alias("heat"))
    none = c.select("id").limit(0)
    gates = {"exclude": list(_EXCLUDE), "media": ["en", "de", "fr"], "least_seconds": 20.0, "most_seconds": 600.0, "least_heat": 400.0}
    return themed_selection(spark, c, none, scratch(spark, "themed"), _THEME, gates, None, {"floor": 20_000, "ceiling": 60_000})["audit"]
