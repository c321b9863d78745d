"""Ordered selection: best rows, ranks, quotas by running sums, audits of what was left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.number import half_up
from postmill.sinks.scratch import stored


def best(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return top(df, keys, 1, *order)


def top(df: DataFrame, keys: Sequence[str], n: int | Column, *order: Column, keep_rank: str | None = None) -> DataFrame:
    """The first n rows of each key; keep_rank: a column for their places."""
    name = keep_rank or "_place"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if keep_rank else out.drop(name)


def ranked(df: DataFrame, name: str, *order: Column, within: Sequence[str] = ()) -> DataFrame:
    """With each row's place. Without keys Spark sorts in one task: for what is small by then (a report)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """Sorted by range: _range, and _at, a row's place in it."""
    low = (1 << 33) - 1  # of these bits is a row's number in its partition
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(x, "numbered").withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(low)))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """With each row's place in the whole table: sorted by range, numbered within a range, moved on by the ranges before."""
    x = in_ranges(df, *order)
    size = x.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = size.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return x.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; null if none does. A null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def audit(df: DataFrame, reason: str = "reason", passed: str = "kept") -> DataFrame:
    """Rows by reason."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit(passed)).alias(reason)).agg(F.count("*").alias("n"))


def within_budget(df: DataFrame, size: str, budget: Column | int, keys: Sequence[str], *order: Column, per_item: int | None = None, name: str = "granted") -> DataFrame:
    """How much of each row a budget grants: at most per_item, at most what the rows before it leave."""
    want = F.least(F.col(size), F.lit(per_item)) if per_item is not None else F.col(size)
    before = F.coalesce(F.sum(want).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = budget if isinstance(budget, Column) else F.lit(budget)
    return df.withColumn(name, F.least(want, F.greatest(F.lit(0), total - before)))


def evict_oldest(df: DataFrame, size: str, quota: int, keys: Sequence[str], *oldest_first: Column) -> DataFrame:
    """Marks, oldest first, what must go until the rest fits a quota. Rows are sorted by range over all keys, and a range
    knows what its key holds from there on, so a key with most of the rows is many tasks' work."""
    x = in_ranges(df, *[F.asc(k) for k in keys], *oldest_first)
    part = x.groupBy("_range", *keys).agg(F.sum(size).alias("_sum"))  # a row for each range and key in it
    w = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, 0)
    part = part.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.sum("_sum").over(w).alias("_left"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = x.withColumn("_before", before).join(part, same)
    return x.withColumn("evicted", F.col("_left") - F.col("_before") > F.lit(quota)).drop("_range", "_at", "_before", "_r", "_left", *[f"_k{i}" for i in range(len(keys))])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """A column for the value at place round-half-even((n - 1) * share) of each key's sorted values (nulls first). Values
    are sorted by range over all keys, so a key with most of the rows is many tasks' work; a null key is a key."""
    k = [f"_k{i}" for i in range(len(keys))]
    x = numbered(df.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(value).alias("_value")), "_place", *[F.asc(n) for n in k], F.asc("_value"))
    at = x.groupBy(*k).agg((F.min("_place") + F.bround((F.count("*") - 1) * F.lit(share)).cast("bigint")).alias("_place"))
    found = x.select("_place", F.col("_value").alias(name)).join(at, "_place").drop("_place")
    same = F.lit(True)
    for c, n in zip(keys, k):
        same = same & df[c].eqNullSafe(found[n])
    return df.join(found, same, "left").drop(*k)


def evenly(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """At most `most` rows of each key, evenly spread over its order, the ends included."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    if most == 1:
        return x.filter("_i = 0").drop("_i", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(most - 1)).cast("int"))
    return x.filter((F.col("_n") <= most) | F.array_contains(picks, F.col("_i").cast("int"))).drop("_i", "_n")


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of neighbouring rows with the flag set: keys, first and last place (from 0), length."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_f", flag)
    x = x.filter("_f").withColumn("_g", F.col("_i") - F.row_number().over(w))
    return x.groupBy(*keys, "_g").agg(F.min("_i").alias("run_start"), F.max("_i").alias("run_end"), F.count("*").alias("run_length")).drop("_g")


def chunks(start: Column, end: Column, least: float, most: float) -> Column:
    """Stretches [start, end) of an interval, `most` long; a last shorter one if at least `least` long."""
    n = F.floor((end - start) / F.lit(most)).cast("int")
    rest = (end - start) - n * F.lit(most)
    count = n + F.when(rest >= F.lit(least - 1e-9), 1).otherwise(0)
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(half_up(start + i * F.lit(most), 3).alias("clip_start"), half_up(F.least(end, start + (i + 1) * F.lit(most)), 3).alias("clip_end")))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<struct<clip_start:double,clip_end:double>>"))
