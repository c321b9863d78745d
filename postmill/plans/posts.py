"""Queries over posts (events): heat, scores, windows, evaluation, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions.number import half_up, log_points, parse_count
from postmill.functions.time import day_end, hours_before, parse_published
from postmill.operators import scores
from postmill.operators.joins import same_sets, upsert_seen
from postmill.operators.select import audit, best, first_reason, ranked, top
from postmill.plans.registry import query
from postmill.sources.tables import POSTS_SQL, posts, table

METRICS = ("likes", "comments", "collects", "shares")
_SUMS = ", ".join(f"coalesce(sum({m}), 0) as {m}" for m in METRICS)
_P = lambda m, w: f"round({w} * least(1.0, ln(1 + greatest({m}, 0)) / ln(1 + 1000000.0)), 3)"


@query(f"""
with {POSTS_SQL},
seen as (select day, video_id, account_id, max(published) as published, {_SUMS} from posts group by all),
merged as (
  select * from (select *, row_number() over (partition by day, video_id order by likes + comments + collects + shares desc, published desc, account_id desc) as i from seen)
  where i = 1),
lanes as (select day, video_id % 20 as story_id, count(distinct account_id % 2) as n_lanes, count(distinct account_id) as n_accounts, count(distinct video_id) as n_videos, max(published) as newest
  from seen group by all),
chosen as (
  select * from (select *, video_id % 20 as story_id, account_id % 10 as group_id,
    row_number() over (partition by day, video_id % 20, account_id % 10 order by likes + comments + collects + shares desc, published desc, video_id desc) as j from merged)
  where j = 1),
effective as (select day, story_id, count(*) as n_groups, cast(sum(likes) as bigint) as likes, cast(sum(comments) as bigint) as comments, cast(sum(collects) as bigint) as collects, cast(sum(shares) as bigint) as shares
  from chosen group by all),
scored as (
  select e.*, n_lanes, n_accounts, n_videos, newest,
    round({_P('likes', 22)} + {_P('comments', 20)} + {_P('collects', 18)} + {_P('shares', 22)}
      + round(10 * exp(-least(24.0, greatest(0.0, (epoch_us(cast(e.day as timestamp) + interval 86399 second) - epoch_us(newest)) / 3600000000.0)) / 24.0), 3)
      + round(4 * least(1.0, ln(1 + n_groups) / ln(11)), 3) + round(2 * least(1.0, n_groups / 3), 3)
      + case when n_lanes > 1 then 2.0 else 0.0 end, 3) as heat
  from effective e join lanes l on e.day = l.day and e.story_id = l.story_id)
select day, story_id, n_videos, n_accounts, n_groups, n_lanes, likes, comments, collects, shares, heat, heat_rank from (
  select *, row_number() over (partition by day order by heat desc, n_groups desc, newest, story_id) as heat_rank from scored)
where heat_rank <= 10""")
def daily_event_heat(spark, sf_dir):
    """Posts merged to one row a video, one video a source group and story, heat by story, the ten hottest of a day."""
    total = F.col("likes") + F.col("comments") + F.col("collects") + F.col("shares")
    seen = posts(spark, sf_dir).groupBy("day", "video_id", "account_id").agg(F.max("published").alias("published"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in METRICS])
    seen = seen.withColumn("story_id", F.col("video_id") % 20)
    lanes = seen.groupBy("day", "story_id").agg(
        F.countDistinct(F.col("account_id") % 2).alias("n_lanes"), F.countDistinct("account_id").alias("n_accounts"), F.countDistinct("video_id").alias("n_videos"), F.max("published").alias("newest")
    )
    merged = best(seen, ["day", "video_id"], total.desc(), F.desc("published"), F.desc("account_id"))
    chosen = best(merged.withColumn("group_id", F.col("account_id") % 10), ["day", "story_id", "group_id"], total.desc(), F.desc("published"), F.desc("video_id"))
    effective = chosen.groupBy("day", "story_id").agg(F.count("*").alias("n_groups"), *[F.sum(m).alias(m) for m in METRICS])
    x = effective.join(lanes, ["day", "story_id"])
    x = x.withColumn("heat", scores.heat(hours_before(F.col("newest"), day_end(F.col("day")), 0.0, 24.0), F.col("n_groups"), F.col("n_lanes")))
    x = top(x, ["day"], 10, F.desc("heat"), F.desc("n_groups"), F.asc("newest"), F.asc("story_id"), keep_rank="heat_rank")
    return x.select("day", "story_id", "n_videos", "n_accounts", "n_groups", "n_lanes", *METRICS, "heat", "heat_rank")


_ENGAGE = "coalesce(likes, 0) * 1.0::double + coalesce(comments, 0) * 3.0::double + coalesce(shares, 0) * 5.0::double + coalesce(collects, 0) * 4.0::double + coalesce(plays, 0) * 0.05::double"


@query(f"""
with {POSTS_SQL}, e as (select *, {_ENGAGE} as engagement from posts),
m as (select day, account_id, median(engagement) as median from e group by all having count(*) >= 3 and median(engagement) > 0)
select event_id, day, account_id, engagement, score, row_number() over (partition by day order by score desc, event_id) as day_rank from (
  select event_id, e.day, e.account_id, engagement,
    round(least(100.0, 10.0 + least(1.0, greatest(0.0, (epoch_us(published) - epoch_us(cast(e.day as timestamp))) / 86400000000.0)) * 15
      + case when engagement > 0 then least(40.0, log10(1.0 + engagement) * 8) else 0.0 end
      + case when event_type <> 'view' then 15.0 else 0.0 end
      + case when event_type = 'purchase' then 5.0 when event_type = 'click' then 3.0 else 0.0 end
      + greatest(0.0, 5.0 - 4 * 1.5)
      + case when median > 0 then least(15.0, greatest(0.0, log2(greatest(1.0, engagement / median)) * 6)) else 0.0 end), 3) as score
  from e left join m on e.day = m.day and e.account_id = m.account_id)""")
def post_engagement_score(spark, sf_dir):
    """Every post's score of its day, with the account's median of the day as the base of its anomaly."""
    p = posts(spark, sf_dir).withColumn("engagement", scores.engagement())
    m = p.groupBy("day", "account_id").agg(F.percentile("engagement", F.lit(0.5)).alias("median"), F.count("*").alias("n")).filter("n >= 3 and median > 0").drop("n")
    x = p.join(m, ["day", "account_id"], "left")
    progress = (F.unix_micros(F.col("published").cast("timestamp")) - F.unix_micros(F.col("day").cast("timestamp"))) / F.lit(8.64e10)
    bonus = F.when(F.col("event_type") == "purchase", 5.0).when(F.col("event_type") == "click", 3.0).otherwise(0.0)
    x = x.withColumn("score", scores.post_score(progress, F.col("engagement"), F.col("median"), F.col("event_type") != "view", bonus, F.lit(4)))
    return ranked(x.select("event_id", "day", "account_id", "engagement", "score"), "day_rank", F.desc("score"), F.asc("event_id"), within=["day"])


@query(f"""
with {POSTS_SQL}, r as (select case when video_id % 17 = 0 then 'no_link' when video_id is null then 'no_title' when published is null then 'no_time'
  when not (published >= timestamp '2024-01-10' and published < timestamp '2024-01-11') then 'outside_day' end as reason from posts)
select coalesce(reason, 'eligible') as reason, count(*) as n from r group by 1""")
def exclusion_audit(spark, sf_dir):
    """Why posts are not eligible for one business day."""
    p = posts(spark, sf_dir)
    t = F.col("published")
    reason = first_reason(
        (F.col("video_id") % 17 == 0, "no_link"), (F.col("video_id").isNull(), "no_title"), (t.isNull(), "no_time"),
        (~((t >= F.lit("2024-01-10").cast("timestamp_ntz")) & (t < F.lit("2024-01-11").cast("timestamp_ntz"))), "outside_day"),
    )
    return audit(p.withColumn("reason", reason), passed="eligible")


_WRITTEN = """case n_chars % 6 when 0 then cast(n_chars as varchar) || '+' when 1 then cast(n_chars / 100.0 as decimal(18, 2)) || '万' when 2 then cast(n_chars % 90 as varchar) || 'K'
  when 3 then (n_chars % 7) || '.5亿' when 4 then 'n/a' else substr(cast(n_chars + 1000 as varchar), 1, 1) || ',' || substr(cast(n_chars + 1000 as varchar), 2) end"""


@query(f"""
with w as (select doc_id, {_WRITTEN} as written from documents),
c as (select doc_id, written, lower(regexp_replace(trim(written), '[,+ ]', '', 'g')) as t from w)
select doc_id, written, case when regexp_matches(t, '^[0-9]+(\\.[0-9]+)?(万|亿|k|m)?$') then cast(trunc(cast(regexp_extract(t, '^([0-9]+(\\.[0-9]+)?)', 1) as double)
  * case regexp_extract(t, '(万|亿|k|m)$', 1) when '万' then 1e4 when '亿' then 1e8 when 'k' then 1e3 when 'm' then 1e6 else 1 end) as bigint) end as parsed
from c""")
def count_parse(spark, sf_dir):
    """Counts in the ways that exports write them, as numbers."""
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    plus = (n + 1000).cast("string")
    written = (
        F.when(n % 6 == 0, F.concat(n.cast("string"), F.lit("+"))).when(n % 6 == 1, F.concat((n / F.lit(100.0)).cast("decimal(18,2)").cast("string"), F.lit("万")))
        .when(n % 6 == 2, F.concat((n % 90).cast("string"), F.lit("K"))).when(n % 6 == 3, F.concat((n % 7).cast("string"), F.lit(".5亿")))
        .when(n % 6 == 4, F.lit("n/a")).otherwise(F.concat(F.substring(plus, 1, 1), F.lit(","), F.substring(plus, 2, 30)))
    )
    return d.select("doc_id", written.alias("written"), parse_count(written).alias("parsed"))


@query("""
with w as (select event_id, ts, case event_id % 5 when 0 then cast(epoch(date_trunc('second', ts))::bigint as varchar) when 1 then cast(epoch_us(ts) // 1000 as varchar)
  when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' when 3 then strftime(ts, '%Y-%m-%d %H:%M:%S') else 'yesterday' end as written from events)
select event_id, written, case event_id % 5 when 0 then epoch(date_trunc('second', ts))::bigint when 1 then (epoch_us(ts) // 1000000)::bigint when 2 then epoch(date_trunc('second', ts))::bigint
  when 3 then epoch(date_trunc('second', ts))::bigint - 28800 end as epoch_seconds from w""")
def datetime_parse(spark, sf_dir):
    """Published times as epoch seconds, milliseconds, ISO with an offset and local ISO, back to an instant."""
    e = table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 5
    written = (
        F.when(k == 0, F.unix_seconds(t).cast("string")).when(k == 1, F.unix_millis(t).cast("string")).when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("yesterday"))
    )
    return e.select("event_id", written.alias("written"), F.unix_seconds(parse_published(written)).alias("epoch_seconds"))


@query(f"""
with {POSTS_SQL}
select day, event_type, event_id, account_id, place from (select *, row_number() over (partition by day, event_type order by published desc, event_id desc) as place from posts) where place <= 3""")
def per_keyword_topk(spark, sf_dir):
    """The three newest posts of each day and keyword."""
    x = top(posts(spark, sf_dir), ["day", "event_type"], 3, F.desc("published"), F.desc("event_id"), keep_rank="place")
    return x.select("day", "event_type", "event_id", "account_id", "place")


@query(f"""
with {POSTS_SQL}, f as (select *, video_id % 5 = 0 as tech, video_id % 11 = 0 as promo, case when event_type = 'view' then null else video_id end as duration from posts
  where day between date '2024-01-10' and date '2024-01-23'),
k as (select * from (select *, row_number() over (partition by account_id order by published desc, event_id) as i from f) where i <= 30),
a as (select account_id, count(*) as total_posts, count(distinct day) as active_days, round(count_if(tech) / count(*), 4) as tech_ratio, round(count_if(promo) / count(*), 4) as promo_ratio,
    round(count_if(duration <= 60) / nullif(count(duration), 0), 4) as short_ratio, round((count(*) - count(duration)) / count(*), 4) as duration_missing,
    round(median(likes), 2) as like_median, round((count(*) - count(likes)) / count(*), 4) as like_missing from k group by 1)
select *, case when total_posts < 5 then 'insufficient_data'
    when active_days >= 7 and tech_ratio >= 0.2 and short_ratio >= 0.5 and promo_ratio <= 0.15 and 1 - duration_missing >= 0.5 then 'core_candidate'
    when active_days >= 4 and tech_ratio >= 0.2 and promo_ratio <= 0.15 then 'supplemental_candidate' when tech_ratio < 0.2 then 'do_not_use' when promo_ratio > 0.15 then 'do_not_use' else 'insufficient_data' end as recommendation,
  case when like_missing > 0.95 then 'low' when duration_missing > 0.4 or like_missing > 0.75 then 'medium' else 'high' end as data_quality
from a""")
def account_evaluation(spark, sf_dir):
    """Fourteen days of each account, its thirty newest posts: ratios, medians, missing rates, and a recommendation."""
    p = posts(spark, sf_dir).filter(F.col("day").between("2024-01-10", "2024-01-23"))
    p = p.withColumn("duration", F.when(F.col("event_type") != "view", F.col("video_id")))
    k = top(p, ["account_id"], 30, F.desc("published"), F.asc("event_id"))
    n, known = F.count("*"), F.count("duration")
    ratio = lambda a, b: half_up(a / b, 4)
    a = k.groupBy("account_id").agg(
        n.alias("total_posts"), F.countDistinct("day").alias("active_days"), ratio(F.count_if(F.col("video_id") % 5 == 0), n).alias("tech_ratio"), ratio(F.count_if(F.col("video_id") % 11 == 0), n).alias("promo_ratio"),
        ratio(F.count_if(F.col("duration") <= 60), F.nullif(known, F.lit(0))).alias("short_ratio"), ratio(n - known, n).alias("duration_missing"),
        half_up(F.percentile("likes", F.lit(0.5)), 2).alias("like_median"), ratio(n - F.count("likes"), n).alias("like_missing"),
    )
    c = F.col
    good, calm = c("tech_ratio") >= 0.2, c("promo_ratio") <= 0.15
    core = (c("active_days") >= 7) & good & (c("short_ratio") >= 0.5) & calm & (1 - c("duration_missing") >= 0.5)
    advice = (
        F.when(c("total_posts") < 5, "insufficient_data").when(core, "core_candidate").when((c("active_days") >= 4) & good & calm, "supplemental_candidate")
        .when(~good | ~calm, "do_not_use").otherwise("insufficient_data")
    )
    quality = F.when(c("like_missing") > 0.95, "low").when((c("duration_missing") > 0.4) | (c("like_missing") > 0.75), "medium").otherwise("high")
    return a.withColumn("recommendation", advice).withColumn("data_quality", quality)


@query(f"""
with {POSTS_SQL}, w as (select * from posts where published >= timestamp '2024-01-20 12:00:00' - interval 48 hour and published <= timestamp '2024-01-20 12:00:00'),
u as (select * from (select *, row_number() over (partition by video_id order by published desc, event_id) as i from w) where i = 1),
m as (select *, max(ln(1 + likes)) over () as ml, max(ln(1 + comments)) over () as mc, max(ln(1 + collects)) over () as mk, max(ln(1 + shares)) over () as ms from u)
select video_id, event_id, round(coalesce(30 * ln(1 + likes) / nullif(ml, 0), 0) + coalesce(25 * ln(1 + comments) / nullif(mc, 0), 0) + coalesce(15 * ln(1 + collects) / nullif(mk, 0), 0)
    + coalesce(20 * ln(1 + shares) / nullif(ms, 0), 0) + 10 * greatest(0.0, 1 - (epoch_us(timestamp '2024-01-20 12:00:00') - epoch_us(published)) / 3600000000.0 / 48), 3) as score,
  ((likes is not null)::int + (comments is not null)::int + (collects is not null)::int + (shares is not null)::int) / 4 as completeness from m""")
def window_48h_rank(spark, sf_dir):
    """The newest post of each video in 48 hours, metrics as shares of the window's greatest, age linear; missing metrics add nothing."""
    end = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    t = F.col("published")
    w = posts(spark, sf_dir).filter((t >= end - F.expr("interval 48 hours")) & (t <= end))
    u = best(w, ["video_id"], F.desc("published"), F.asc("event_id"))
    tops = u.agg(*[F.max(F.log1p(m)).alias(f"max_{m}") for m in METRICS])
    x = u.join(F.broadcast(tops))  # one row
    score = F.lit(10.0) * F.greatest(F.lit(0.0), 1 - hours_before(t, end, 0.0, 1e9) / 48)
    for m, weight in zip(METRICS, (30, 25, 15, 20), strict=True):
        score = score + F.coalesce(F.lit(weight) * F.log1p(m) / F.nullif(F.col(f"max_{m}"), F.lit(0.0)), F.lit(0.0))
    complete = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0)) / 4
    return x.select("video_id", "event_id", half_up(score, 3).alias("score"), complete.alias("completeness"))


@query(f"""
with {POSTS_SQL}, s as (select video_id, account_id, min(day) as first_seen, max(day) as last_seen, list_sort(list(distinct day)) as days from posts where day < date '2024-01-15' group by all),
n as (select video_id, account_id, min(day) as f, max(day) as l, list(distinct day) as ds from posts where day >= date '2024-01-15' and day < date '2024-01-25' group by all)
select coalesce(s.video_id, n.video_id) * 1000000 + coalesce(s.account_id, n.account_id) as seen_id, least(first_seen, f) as first_seen, greatest(last_seen, l) as last_seen,
  array_to_string(list_transform((list_sort(list_distinct(list_concat(coalesce(days, []), coalesce(ds, [])))))[-5:], lambda x: cast(x as varchar)), ',') as days,
  case when first_seen is null then 'new' when f is null then 'unchanged' else 'seen_again' end as status
from s full outer join n on s.video_id = n.video_id and s.account_id = n.account_id""")
def seen_state_upsert(spark, sf_dir):
    """Seen-state before a day, with ten days of sightings put in; the last five days are kept."""
    p = posts(spark, sf_dir).select((F.col("video_id") * 1000000 + F.col("account_id")).alias("seen_id"), "day")
    state = p.filter("day < '2024-01-15'").groupBy("seen_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.array_sort(F.collect_set("day")).alias("days"))
    out = upsert_seen(state, p.filter("day >= '2024-01-15' and day < '2024-01-25'"), "seen_id", 5)
    return out.withColumn("days", F.array_join(F.transform("days", lambda d: d.cast("string")), ","))


@query(f"""
with {POSTS_SQL}, r as (select * from (select *, row_number() over (partition by video_id order by value desc, event_id) as i from posts where event_type in ('click', 'purchase')) where i <= 3),
s as (select video_id, count(*) as n_results, cast(sum(likes) as bigint) as likes, cast(sum(shares) as bigint) as shares, min(event_id) as first_id from r group by 1),
e as (select video_id, count(*) as n_posts from posts group by 1)
select e.video_id, n_posts, coalesce(n_results, 0) as n_results, coalesce(likes, 0) as likes, coalesce(shares, 0) as shares, first_id from e left join s on e.video_id = s.video_id""")
def signal_topk_join(spark, sf_dir):
    """Each event with the sums of its three best search results."""
    p = posts(spark, sf_dir)
    r = top(p.filter(F.col("event_type").isin("click", "purchase")), ["video_id"], 3, F.desc("value"), F.asc("event_id"))
    s = r.groupBy("video_id").agg(F.count("*").alias("n_results"), F.sum("likes").alias("likes"), F.sum("shares").alias("shares"), F.min("event_id").alias("first_id"))
    x = p.groupBy("video_id").agg(F.count("*").alias("n_posts")).join(s, "video_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select("video_id", "n_posts", z("n_results"), z("likes"), z("shares"), "first_id")


@query(f"""
with {POSTS_SQL}, s as (select account_id, list_sort(list(distinct video_id % 12)) as days from posts where event_type = 'signup' group by 1)
select array_to_string(list_sort(list(account_id)), ',') as owners, len(days) as n_members from s group by days having count(*) > 1""")
def identity_collision(spark, sf_dir):
    """Accounts with the same set of sign-up topics."""
    p = posts(spark, sf_dir).filter("event_type = 'signup'").withColumn("topic", F.col("video_id") % 12)
    return same_sets(p, "account_id", "topic").select(F.array_join("owners", ",").alias("owners"), F.col("n_members").cast("bigint").alias("n_members"))


@query(f"""
with {POSTS_SQL}, s as (select *, row_number() over (partition by account_id order by published, event_id) - 1 as i from posts),
f as (select account_id, i, i - row_number() over (partition by account_id order by published, event_id) as g from s where event_type <> 'view'),
r as (select account_id, min(i) as run_start, max(i) as run_end, count(*) as run_length from f group by account_id, g)
select account_id, run_start, run_end, run_length, clip_start, least(run_end + 1, clip_start + 8) as clip_end
from (select *, unnest(generate_series(run_start, run_end, 8)) as clip_start from r)
where least(run_end + 1, clip_start + 8) - clip_start >= 3""")
def face_free_runs(spark, sf_dir):
    """Runs of an account's posts without a view, one second a post, cut to clips of 3 to 8 seconds."""
    from postmill.operators.select import chunks, islands

    p = posts(spark, sf_dir).withColumn("place", F.struct("published", "event_id"))
    r = islands(p, ["account_id"], "place", F.col("event_type") != "view")
    x = r.select("*", F.explode(chunks(F.col("run_start").cast("double"), (F.col("run_end") + 1).cast("double"), 3.0, 8.0)).alias("c"))
    return x.select("account_id", F.col("run_start").cast("bigint").alias("run_start"), F.col("run_end").cast("bigint").alias("run_end"), "run_length", F.col("c.clip_start").cast("bigint").alias("clip_start"), F.col("c.clip_end").cast("bigint").alias("clip_end"))


@query(f"""
with {POSTS_SQL}, d as (select day, count(*) as candidate_count, count(distinct video_id) as target_day_videos, count_if(event_type = 'purchase') as image_successes, count_if(event_type = 'error') as source_errors from posts group by 1),
p as (select n.day, n.candidate_count as nc, n.target_day_videos as nv, n.image_successes as ni, n.source_errors as ne, c.candidate_count as cc, c.target_day_videos as cv, c.image_successes as ci, c.source_errors as ce
  from d n left join d c on c.day = n.day - 1)
select day, case when cc is null then 'no_comparable_same_day_current' when ne > ce + 20 then 'official_source_errors_increased' when nc > cc then 'candidate_count_increased' when nc < cc then 'candidate_count_decreased'
  when nv > cv then 'target_day_videos_increased' when nv < cv then 'target_day_videos_decreased' when ni > ci then 'top3_image_successes_increased' when ni < ci then 'top3_image_successes_decreased'
  else 'same_quality_not_promoted' end as reason,
  case when cc is null then true when ne > ce + 20 then false when nc > cc then true when nc < cc then false when nv > cv then true when nv < cv then false when ni > ci then true else false end as promoted
from p""")
def promotion_decision(spark, sf_dir):
    """Whether each day's package may replace the one before: an ordered comparison of its quality."""
    p = posts(spark, sf_dir).groupBy("day").agg(
        F.count("*").alias("candidate_count"), F.countDistinct("video_id").alias("target_day_videos"), F.count_if(F.col("event_type") == "purchase").alias("top3_image_successes"), F.count_if(F.col("event_type") == "error").alias("source_errors")
    )
    fields = ("candidate_count", "target_day_videos", "top3_image_successes")
    c = p.select(F.date_add("day", 1).alias("day"), *[F.col(x).alias(f"now_{x}") for x in (*fields, "source_errors")])
    x = p.join(c, "day", "left")
    rules = [(F.col("now_candidate_count").isNull(), "no_comparable_same_day_current"), (F.col("source_errors") > F.col("now_source_errors") + 20, "official_source_errors_increased")]
    for f in fields:
        rules += [(F.col(f) > F.col(f"now_{f}"), f"{f}_increased"), (F.col(f) < F.col(f"now_{f}"), f"{f}_decreased")]
    x = x.withColumn("reason", F.coalesce(first_reason(*rules), F.lit("same_quality_not_promoted")))
    better = [f"{f}_increased" for f in fields] + ["no_comparable_same_day_current"]
    return x.select("day", "reason", F.col("reason").isin(better).alias("promoted"))


@query(f"""
with {POSTS_SQL}, p as (select *, date_diff('hour', published, cast(day as timestamp) + interval 86399 second) as h from posts)
select day, event_id, round({_P('coalesce(likes, 0)', 22)} + {_P('coalesce(comments, 0)', 20)} + {_P('coalesce(collects, 0)', 18)} + {_P('coalesce(shares, 0)', 22)}
  + round(10 * exp(-least(48.0, greatest(0.0, (epoch_us(cast(day as timestamp) + interval 86399 second) - epoch_us(published)) / 3600000000.0)) / 24.0), 3), 3) as board_score
from (select *, row_number() over (partition by day order by published, event_id) as i from p) where i <= 10""")
def ranking_board_components(spark, sf_dir):
    """The board: the first ten posts of a day by time (the cap comes before any score), with their components' sum."""
    p = top(posts(spark, sf_dir), ["day"], 10, F.asc("published"), F.asc("event_id"))
    s = F.lit(0.0)
    for m in METRICS:
        s = s + log_points(F.coalesce(F.col(m), F.lit(0)), scores.HEAT[m])
    s = s + half_up(10 * F.exp(-hours_before(F.col("published"), day_end(F.col("day")), 0.0, 48.0) / 24.0), 3)
    return p.select("day", "event_id", half_up(s, 3).alias("board_score"))


@query(f"""
with {POSTS_SQL}
select case when grouping(event_type) = 1 then 'all' else event_type end as event_type, case when grouping(day) = 1 then 'all' else cast(day as varchar) end as day_label, count(*) as n_posts, count(distinct account_id) as n_accounts, cast(coalesce(sum(likes), 0) as bigint) as likes
from posts group by grouping sets ((event_type, day), (event_type), (day), ())""")
def run_summary(spark, sf_dir):
    """Counts by type and day, by each, and over all, in one pass."""
    p = posts(spark, sf_dir)
    x = p.groupingSets([("event_type", "day"), ("event_type",), ("day",), ()], "event_type", "day").agg(
        F.when(F.grouping("event_type") == 1, "all").otherwise(F.col("event_type")).alias("event_type_label"),
        F.when(F.grouping("day") == 1, "all").otherwise(F.col("day").cast("string")).alias("day_label"),
        F.count("*").alias("n_posts"), F.countDistinct("account_id").alias("n_accounts"), F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"),
    )
    return x.select(F.col("event_type_label").alias("event_type"), "day_label", "n_posts", "n_accounts", "likes")


@query(f"""
with {POSTS_SQL}
select account_id, week, n_days, prior_days from (
  select account_id, week, n_days, lag(n_days) over (partition by account_id order by week) as prior_days from (select account_id, cast(date_trunc('week', day) as date) as week, count(distinct day) as n_days from posts group by all))""")
def weekly_activity(spark, sf_dir):
    """Active days of each account and week, beside those of its week before."""
    x = posts(spark, sf_dir).groupBy("account_id", F.to_date(F.date_trunc("week", F.col("day"))).alias("week")).agg(F.countDistinct("day").alias("n_days"))
    return x.withColumn("prior_days", F.lag("n_days").over(Window.partitionBy("account_id").orderBy("week")))
