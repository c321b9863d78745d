"""Constraints as tables of violations: (row_id, rule). An empty table is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, row_id: str, rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; rules are conditions that must hold (null: broken). One scan."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(F.col(row_id).cast("string").alias("row_id"), F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once."""
    x = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return x.select(F.concat_ws("|", *keys).alias("row_id"), F.lit(rule).alias("rule"))


def not_monotone(df: DataFrame, keys: Sequence[str], order: str, value: str, rule: str) -> DataFrame:
    """Rows whose value is below that of the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_p", F.lag(value).over(w)).filter(F.col("_p") > F.col(value)).select(F.concat_ws("|", *keys, order).alias("row_id"), F.lit(rule).alias("rule"))


def total_is(df: DataFrame, value: Column, low: float, high: float, rule: str) -> DataFrame:
    """The rule, if an aggregate is out of bounds."""
    return df.agg(value.alias("_v")).filter((F.col("_v") < low) | (F.col("_v") > high)).select(F.lit("").alias("row_id"), F.lit(rule).alias("rule"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
