"""Small relation graphs: reachability by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.sinks.scratch import stored


def on_cycles(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b) edges -> node: nodes that reach themselves. For small graphs of claims or topics.

    First every node without an edge out, or none in, is taken away until none is left to take: those are on no
    cycle. Then the lengths of known paths double each round, so rounds are few.
    """

    def cut(df: DataFrame) -> tuple[DataFrame, int]:  # each round from rows, not from a growing plan
        df = stored(df, "graph")
        return df, df.count()

    e, n = cut(edges.select("a", "b").distinct())
    for _ in range(most_rounds):
        both = e.select(F.col("b").alias("x")).intersect(e.select(F.col("a").alias("x")))
        kept, left = cut(e.join(both.withColumnRenamed("x", "a"), "a", "left_semi").join(both.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b"))
        done = left == n
        e, n = kept, left
        if done:
            break
    paths = e
    for _ in range(most_rounds):
        first, second = paths.select(F.col("a").alias("root"), F.col("b").alias("via")), paths.select(F.col("a").alias("via"), "b")
        longer, m = cut(paths.union(first.join(second, "via").select(F.col("root").alias("a"), "b")).distinct())
        done = m == n
        paths, n = longer, m
        if done:
            break
    return paths.filter("a = b").select(F.col("a").alias("node"))
