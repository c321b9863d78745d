"""Jobs made of the operators: daily news, and the ranking board of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.number import half_up, log_points
from postmill.functions.text import pairs_of_characters, tokens
from postmill.functions.time import day_end, hours_before
from postmill.operators import folds, scores
from postmill.operators.joins import token_overlap
from postmill.operators.select import best, ranked, top


def daily_news(articles: DataFrame, posts: DataFrame, top_n: int = 30) -> DataFrame:
    """Articles (schema.ARTICLE) and posts (video_id, title, interactions) to ranked events of each day.

    Articles join the event with the most similar first title; a primary source or two domains confirm it; the five
    posts that share most tokens with its title lend it their engagement.
    """
    a = articles.withColumn("day", F.to_date("published")).withColumn("pairs", pairs_of_characters(F.col("title")))
    a = folds.best_title_clusters(a, ["day"], [("published", True), ("url", True)], "pairs")
    place = F.struct("published", "url")
    e = a.groupBy("day", "cluster").agg(
        F.min_by("title", place).alias("title"), F.count("*").alias("n_articles"), F.countDistinct(F.coalesce("domain", "source")).alias("n_domains"), F.bool_or(F.col("source_kind").isin("official", "primary")).alias("primary")
    )
    e = e.withColumn("event_id", F.concat_ws("-", "day", "cluster")).withColumn("confirmed", F.col("primary") | (F.col("n_domains") >= 2))
    p = posts.withColumn("engagement", scores.engagement()).withColumn("tokens", tokens(F.coalesce("title", F.lit(""))))
    near = token_overlap(e.select("event_id", tokens(F.col("title")).alias("tokens")), p.select("video_id", "tokens"), "event_id", "video_id")
    near = top(near.join(p.select("video_id", "engagement"), "video_id"), ["event_id"], 5, F.desc("n_shared"), F.desc("engagement"), F.asc("video_id"))
    heat = near.groupBy("event_id").agg(F.sum("engagement").alias("engagement"), F.count("*").alias("n_posts"))
    x = e.join(heat, "event_id", "left").fillna(0, ["engagement", "n_posts"])
    score = F.when(F.col("confirmed"), 40).otherwise(0) + F.least(F.lit(40.0), 8 * F.log10(1 + F.col("engagement"))) + F.least(F.lit(20), 5 * F.col("n_articles"))
    x = x.withColumn("score", half_up(score, 2)).withColumn("level", F.when(F.col("score") >= 75, "S").when(F.col("score") >= 55, "A").otherwise("B"))
    return top(x, ["day"], top_n, F.desc("score"), F.asc("event_id"), keep_rank="rank").select("day", "event_id", "title", "n_articles", "n_domains", "confirmed", "n_posts", "engagement", "score", "level", "rank")


def ranking_board(posts: DataFrame, per_day: int = 10) -> DataFrame:
    """Posts (schema.POST) to a board of each day: one row a video, the first ten by time, clusters by growing tokens,
    components summed by cluster, ranked."""
    x = posts.filter("title is not null and published is not null").withColumn("day", F.to_date("published"))
    age = hours_before(F.col("published"), day_end(F.col("day")), 0.0, 48.0)
    parts = {m: log_points(F.coalesce(F.col(m), F.lit(0)), scores.HEAT[m]) for m in ("likes", "comments", "collects", "shares")} | {"freshness": half_up(10 * F.exp(-age / 24), 3)}
    x = x.withColumns({f"c_{k}": v for k, v in parts.items()}).withColumn("own", half_up(sum((F.col(f"c_{k}") for k in parts), F.lit(0.0)), 3))
    x = best(x, ["day", "video_id"], F.desc("own"), F.asc("url"))
    x = top(x, ["day"], per_day, F.asc("published"), F.asc("video_id")).withColumn("tokens", tokens(F.concat_ws(" ", "title", "keyword")))
    x = folds.token_clusters(x.select("day", "video_id", "title", "published", "own", "tokens", *[f"c_{k}" for k in parts]), ["day"], [("published", True), ("video_id", True)], "tokens")
    c = x.groupBy("day", "cluster").agg(F.max_by("title", F.struct("own", "video_id")).alias("title"), F.count("*").alias("n_videos"), *[half_up(F.sum(f"c_{k}"), 3).alias(k) for k in parts])
    related = half_up(scores.HEAT["related"] * F.least(F.lit(1.0), F.log1p(F.col("n_videos").cast("double")) / F.log(F.lit(11.0))), 3)
    c = c.withColumn("related", related).withColumn("score", half_up(sum((F.col(k) for k in parts), F.lit(0.0)) + related, 3))
    return ranked(c, "rank", F.desc("score"), F.desc("n_videos"), F.asc("title"), within=["day"]).drop("cluster")
