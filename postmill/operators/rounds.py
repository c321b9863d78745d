"""Greedy choices in order, made by rounds of joins: what a row does depends on which rows before it were taken.

A row is settled once every earlier row that could keep it out is settled. In each round the rows that come first among
all open ones that they conflict with are taken, and those which they keep out go. That gives the rows of a loop over the
table exactly. The number of rounds follows the longest chain of conflicts, which is short where order and likeness
are unrelated (about the logarithm of the rows), not the rows; no task holds a key or a component.

Places are numbers of the whole table (operators.select.numbered), so they order and identify rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.select import numbered
from postmill.operators.sets import best_like, first_like, sets_of
from postmill.sinks.scratch import forget, stored


def in_order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """(column, ascending): nulls come last."""
    return [F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c, ascending in order]


def kept_out(edges: DataFrame) -> DataFrame:
    """(a, b), a before b: conflicts -> node: the rows that a taken one before them keeps out. All others are taken."""
    a, b = edges.columns
    left = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "conflicts")
    gone = None
    while not left.isEmpty():
        ready = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = stored(ready.select(F.col("b").alias("node")).distinct(), "kept_out")
        out = lambda side: now.select(F.col("node").alias(side))  # noqa: B023, E731
        # what a ready row conflicts with is out, so none of its conflicts is left
        rest = stored(left.join(out("b"), "b", "left_anti").join(out("a"), "a", "left_anti").select("a", "b"), "conflicts")
        forget(left)
        left, gone = rest, now if gone is None else gone.unionByName(now)
    return gone if gone is not None else left.select(F.col("b").alias("node"))


def kept_out_by_marks(marks: DataFrame) -> DataFrame:
    """(node, mark), different rows: rows with a common mark are in conflict -> node: the rows that are kept out. Conflicts
    aren't spelled out as pairs, so a mark may have any number of rows."""
    node, mark = marks.columns
    left, gone = marks.select(F.col(node).alias("node"), F.col(mark).alias("mark")), None
    while gone is None or not left.isEmpty():
        first = left.groupBy("mark").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        seen = left.join(first, "mark")
        ready = seen.groupBy("node").agg(F.bool_and(F.col("first") == F.col("node")).alias("ready")).filter("ready").select(F.col("node").alias("first"), F.lit(True).alias("ready"))
        hit = seen.join(ready, "first", "left").select("node", "mark", (F.col("first") == F.col("node")).alias("own"), F.col("ready").isNotNull().alias("hit"))
        out = hit.groupBy("node").agg(F.collect_list("mark").alias("marks"), F.bool_or(F.col("hit") & ~F.col("own")).alias("out"), F.bool_and(F.col("hit") & F.col("own")).alias("taken"))
        now = stored(out, "rows")  # a row's marks stay with it, so the next round's rows are what is neither taken nor out
        left = now.filter("not out and not taken").select("node", F.explode("marks").alias("mark"))
        mine = now.filter("out").select("node")
        gone = mine if gone is None else gone.unionByName(mine)
    return gone


def first_of_marks(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], marks: Sequence[str], id_column: str) -> DataFrame:
    """Drops a row if one of its marks was registered by a row of its key that was accepted before; a dropped row
    registers none. Empty and null marks never match. Adds duplicate_of: the id of the row that registered the first of
    its marks (null: accepted)."""
    x = numbered(df, "_place", *in_order(order))
    mark = lambda k, m: F.when(F.col(m).cast("string") != "", F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.lit(k).alias("k"), F.col(m).cast("string").alias("m"))))
    all_marks = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), mark(k, m).alias("mark")) for k, m in enumerate(marks)]), lambda m: m["mark"].isNotNull())
    each = stored(x.select(F.col("_place").alias("node"), F.col(id_column).alias("id"), F.explode(all_marks).alias("m")).select("node", "id", "m.k", "m.mark"), "marks")
    out = kept_out_by_marks(each.select("node", "mark"))
    owner = each.join(out, "node", "left_anti").select("mark", F.col("node").alias("by"), F.col("id").alias("owner"))  # one a mark
    hit = each.join(out, "node", "left_semi").join(owner, "mark").filter("by < node").groupBy(F.col("node").alias("_place")).agg(F.min_by("owner", "k").alias("duplicate_of"))
    return x.join(hit, "_place", "left").drop("_place")


def first_fit(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], items: str, least: int, share: float, best: bool = False) -> DataFrame:
    """Joins a row to the first cluster of its key whose first row shares `least` items with it and `share` of the smaller
    set, else it opens one; best: to the one that shares most, the first of these. Adds cluster (from 0).

    A row opens a cluster if no earlier row that does so is like it (operators.sets, block by block). Equal sets are one
    class, for which its first row stands: a later one is like whatever that is like, and like it.
    """
    x = numbered(df, "_place", *in_order(order))
    members, classes = sets_of(x, "_place", items, least, keys)
    found, heads = first_like(classes, least, share)
    if best:  # a later row of a class may have met a head that its first row had not
        rows = members.select("left_id", "_place").join(classes.select("left_id", "key", "s"), "left_id").select(F.col("_place").alias("left_id"), "key", "s")
        found = best_like(rows, heads, least, share).select(F.col("left_id").alias("_place"), "head")
    else:
        found = members.join(found, "left_id").select("_place", "head")
    found = stored(found, "found")
    x = x.join(found, "_place", "left").withColumn("_head", F.coalesce("head", "_place")).drop("head")
    place = numbered(x.filter("_head = _place").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_head").alias("_own")), "_n", *[F.asc(f"_k{i}") for i in range(len(keys))], F.asc("_own"))
    begin = place.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_n").alias("_begin"))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & place[f"_k{i}"].eqNullSafe(begin[f"_k{i}"])
    index = place.join(begin, same).select(F.col("_own").alias("_head"), (F.col("_n") - F.col("_begin")).cast("int").alias("cluster"))
    return x.join(index, "_head").drop("_head", "_place")


def picks(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], columns: Sequence[str], rounds: Sequence[Sequence[Callable[[Column], Column]]], name: str) -> DataFrame:
    """A few rows of each key, one a round: the first row in order, not taken yet, for which the first possible of the
    round's conditions holds. A condition gets what was taken before, an array of structs of `columns`. Adds `name`: a
    row's place among the picks (from 0; null: not picked).

    Each round is one aggregate with partial minima, and a key's state has as many entries as there were rounds.
    """
    key = F.struct(*keys)
    x = numbered(df, "_place", *in_order(order)).withColumn("_key", key)
    row = F.struct("_place", *columns)
    state = x.select("_key").distinct().withColumn("taken", F.array().cast(f"array<{x.select(row.alias('r')).schema['r'].dataType.simpleString()}>"))
    for conditions in rounds:
        taken = F.col("taken")
        free = ~F.exists(taken, lambda t: t["_place"] == F.col("_place"))
        level = F.lit(None).cast("int")
        for k, c in reversed(list(enumerate(conditions))):
            level = F.when(c(taken), F.lit(k)).otherwise(level)
        level = F.when(free, level)
        found = F.min(F.when(level.isNotNull(), F.struct(level.alias("level"), row.alias("row")))).alias("found")
        state = x.join(state, "_key").groupBy("_key").agg(F.first("taken").alias("taken"), found)
        state = state.select("_key", F.when(F.col("found").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("found.row"))).alias("taken"))
    chosen = state.select(F.posexplode("taken").alias(name, "t")).select(F.col(name), F.col("t._place").alias("_place"))
    return x.join(chosen, "_place", "left").drop("_place", "_key")
