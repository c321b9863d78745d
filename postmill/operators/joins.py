"""Joins of the engine: overrides, token overlap, time windows, references both ways, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.sets import like_pairs, sets_of


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A non-null override replaces a row's value; the first override of a key counts."""
    o = overrides.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = df.join(o, key, "left")
    return x.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def token_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: int = 1) -> DataFrame:
    """Pairs with shared tokens, by an equi-join on tokens: left_key, right_key, n_shared, n_left, n_right.

    left, right: (key, tokens), tokens distinct. Neither side is collected and no pair without a shared token
    is made; a token that most rows have should be taken out before.
    """
    a = left.select(F.col(left_key), F.size("tokens").alias("n_left"), F.explode("tokens").alias("token"))
    b = right.select(F.col(right_key), F.size("tokens").alias("n_right"), F.explode("tokens").alias("token"))
    x = a.join(b, "token").groupBy(left_key, right_key, "n_left", "n_right").agg(F.count("*").alias("n_shared"))
    return x.filter(F.col("n_shared") >= least)


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str], left_label: str, right_label: str) -> DataFrame:
    """References broken in either direction: the keys and which side has no partner."""
    a = left.select(*keys).distinct()
    b = right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("problem", F.lit(left_label)).unionByName(b.join(a, list(keys), "left_anti").withColumn("problem", F.lit(right_label)))


def in_windows(segments: DataFrame, windows: DataFrame, key: str, start: Column, middle: Column, window_start: Column, window_end: Column) -> DataFrame:
    """Segments that begin or have their middle in a window of the same key."""
    inside = lambda t: (t >= window_start) & (t < window_end)
    return segments.join(windows, key).filter(inside(start) | inside(middle))


def upsert_seen(state: DataFrame, new: DataFrame, key: str, dates: int = 30) -> DataFrame:
    """State (key, first_seen, last_seen, days) with new sightings (key, day): first and last widened, the last days kept."""
    n = new.groupBy(key).agg(F.min("day").alias("_first"), F.max("day").alias("_last"), F.collect_set("day").alias("_days"))
    x = state.join(n, key, "full_outer")
    none = F.array().cast("array<date>")
    days = F.array_sort(F.array_union(F.coalesce("days", none), F.coalesce("_days", none)))
    return x.select(
        key,
        F.least("first_seen", "_first").alias("first_seen"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        F.when(F.size(days) > dates, F.slice(days, -dates, dates)).otherwise(days).alias("days"),
        F.when(F.col("first_seen").isNull(), "new").when(F.col("_first").isNull(), "unchanged").otherwise("seen_again").alias("status"),
    )


def latest(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row a key: the newest."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))).filter("_i = 1").drop("_i")


def first_of_sources(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of sources in order; the first source that has a key wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("source_order", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("source_order"))).filter("_i = 1").drop("_i")


def same_sets(df: DataFrame, owner: str, member: str) -> DataFrame:
    """Owners with equal sets of members, two and more: owners, size of the set. An equi-join on the sorted set."""
    sets = df.groupBy(owner).agg(F.array_sort(F.collect_set(member)).alias("members"))
    x = sets.groupBy("members").agg(F.array_sort(F.collect_list(owner)).alias("owners")).filter(F.size("owners") > 1)
    return x.select(F.col("owners"), F.size("members").alias("n_members"))


def near_hashes(df: DataFrame, own: str, bits: str, most: int, keys: Sequence[str] = ()) -> DataFrame:
    """left_id, right_id, distance: pairs of 64-bit hashes, of one key, that differ in at most `most` bits.

    Equal hashes are a class: its first row is linked with each other one (distance 0), and stands for them in pairs
    with other classes. Two hashes within `most` bits have one of most + 1 pieces in common, so classes meet by an
    equi-join on pieces (of 8 bits and more, so `most` is 1 to 7).
    """
    first = df.groupBy(*keys, bits).agg(F.min(own).alias("left_id"))
    same = df.join(first, [*keys, bits]).filter(F.col(own) != F.col("left_id")).select("left_id", F.col(own).alias("right_id"), F.lit(0).alias("distance"))
    width = 64 // (most + 1)
    size = [width] * most + [64 - width * most]  # the last piece takes what is left
    marks = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(bits, k * width).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for k, n in enumerate(size)])
    x = first.select(*keys, "left_id", bits, F.explode(marks).alias("m"))
    y = x.select(*keys, F.col("left_id").alias("right_id"), F.col(bits).alias("_other"), "m")
    p = x.join(y, [*keys, "m"]).filter("left_id < right_id").withColumn("distance", F.bit_count(F.col(bits).bitwiseXOR(F.col("_other")))).filter(F.col("distance") <= most)
    return p.select("left_id", "right_id", "distance").distinct().unionByName(same)


def similar_sets(df: DataFrame, own: str, items: str, least: int, share: float) -> DataFrame:
    """left_id, right_id, n_shared, overlap: pairs of sets with `least` shared items and an overlap of `share` of the
    smaller set. Equal sets are a class: its first row is linked with each other one, and stands for them."""
    members, classes = sets_of(df, own, items, least)
    p = like_pairs(classes, least, share)
    same = members.filter(F.col(own) != F.col("left_id")).select("left_id", F.col(own).alias("right_id"), F.col("n").alias("n_shared"), F.lit(1.0).alias("overlap"))
    return p.unionByName(same)
