"""Connected components by repeated joins, each round from written rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.sinks.scratch import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): the smallest node that each one reaches.

    Every round a node takes the smallest label of its neighbours, and then the label of that label, so that the number
    of rounds follows the logarithm of a chain's length. Neighbours' labels are partly summed before they are shuffled.
    """
    a, b = edges.columns
    both = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    label = stored(both.select("node").distinct().withColumn("root", F.col("node")), "labels")
    before = label
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.least("root", "near").alias("via"), F.col("root").alias("old"))
        jump = label.select(F.col("node").alias("via"), F.col("root").alias("far"))
        now = stored(step.join(jump, "via").select("node", F.least("via", "far").alias("root"), "old"), "labels")
        forget(before)
        label, before = now.select("node", "root"), now
        if now.filter("root <> old").isEmpty():
            forget(both)
            return label
