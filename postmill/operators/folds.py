"""Order-dependent folds: what a row does depends on which rows before it were taken.

A fold runs over the rows of one business key (a day, a story, a video), in a fixed order, as applyInPandas:
Spark deals the keys; the fold's own state stays small. Where a fold's choice can be told by a cheap key
alone, the windows of operators.select do it instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.folds_streamed import streamed
from postmill.operators.joins import near_hashes
from postmill.operators.rounds import first_fit, in_order, kept_out, picks
from postmill.operators.select import numbered
from postmill.operators.sets import Growing
from postmill.sinks.scratch import stored


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], decide: Callable[[pd.DataFrame], dict[str, list]], added: str) -> DataFrame:
    """df with the columns that decide() gives for the sorted rows of each key. order: (column, ascending)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    columns, ascending = [c for c, _ in order], [a for _, a in order]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(columns, ascending=ascending, kind="stable").reset_index(drop=True)
        return rows.assign(**decide(rows))

    return df.groupBy(*keys).applyInPandas(run, schema)


def token_clusters(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], tokens: str, least: int = 3, share: float = 0.55, grow: bool = True) -> DataFrame:
    """Joins a row to the first cluster with `least` shared tokens and an overlap of `share` of the smaller set, else
    opens one. grow: a cluster takes its rows' tokens up, so that it depends on all rows before it; otherwise its first
    row's stand for it, and rounds find the clusters. Adds cluster (from 0)."""
    if not grow:
        return first_fit(df, keys, order, tokens, least, share)

    def begin():
        seen, clusters = Growing(), []

        def one(row):
            t = set(row[tokens])
            k = seen.first(t, least, share)
            if k is None:
                k = len(clusters)
                clusters.append(set())
                seen.add(())
            seen.grow(k, t - clusters[k])
            clusters[k] |= t
            return k

        return one

    return streamed(df, keys, in_order(order), begin, "cluster int")


def best_title_clusters(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], pairs: str, share: float = 0.55) -> DataFrame:
    """Joins an article to the event whose first title is most like its own (overlap of `share`), else opens one."""
    return first_fit(df, keys, order, pairs, 1, share, best=True)


def merge_cards(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], text: str, numbers: str, similarity: float = 0.85) -> DataFrame:
    """Joins a frame's text to the first card that contains it, that it contains, or that is similar; never one with
    other numbers. A card keeps its longest text. Adds card (from 0; null for an empty text) and card_text.

    Which different texts of a key are alike is found first, as pairs of their ids; the fold sees ids and lengths. A card
    always shows the text of some row, so what fits it is a question about two texts.
    """
    x = numbered(df, "_place", *in_order(order)).withColumn("_key", F.struct(*keys)).withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_set", F.array_sort(F.array_distinct(numbers)))
    own = stored(x.filter("_text <> ''").groupBy("_key", "_text", "_set").agg(F.min("_place").alias("id")), "texts")
    a, b = own.select("_key", F.struct("id", "_text", "_set").alias("a")), own.select("_key", F.struct("id", "_text", "_set").alias("b"))
    clash = (F.size("a._set") > 0) & (F.size("b._set") > 0) & (F.col("a._set") != F.col("b._set"))
    inside = F.contains("a._text", F.col("b._text")) | F.contains("b._text", F.col("a._text"))
    short, long = (f(F.length("a._text"), F.length("b._text")) for f in (F.least, F.greatest))
    p = a.join(b, "_key").filter((F.col("a.id") < F.col("b.id")) & ~clash & (inside | (2 * short >= similarity * (short + long))))
    p = p.filter(inside | (matching_share("a._text", "b._text") >= similarity)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    near = p.union(p.select("b", "a")).union(own.select("id", "id")).groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("near"))
    ids = own.join(near, "id").select("id", "_key", "_text", "_set", "near", F.length("_text").alias("n"))

    def decide(rows):
        shown: list[tuple[int, int]] = []  # the text that each card shows: its id and length
        card = []
        for own_id, near, n in zip(rows["id"], rows["near"], rows["n"], strict=True):
            fits = set(near)
            k = next((k for k, (i, _) in enumerate(shown) if i in fits), len(shown))
            shown[k:] = shown[k:] or [(own_id, n)]
            shown[k] = max(shown[k], (own_id, n), key=lambda t: t[1])
            card.append(k)
        return {"card": card, "_shown": [shown[k][0] for k in card]}

    folded = fold(x.select("_place", "_key", "_text", "_set").join(ids, ["_key", "_text", "_set"]).select("_place", "_key", "id", "near", "n"), ["_key"], [("_place", True)], decide, "card int, _shown bigint")
    folded = folded.select("_place", "card", F.col("_shown").alias("id")).join(own.select("id", F.col("_text").alias("card_text")), "id").drop("id")
    return x.join(folded, "_place", "left").drop("_place", "_key", "_text", "_set")


def matching_share(left: str, right: str) -> Column:
    """Characters in common blocks of two texts, as a share of both."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return share(left, right)


def drop_near_hashes(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], bits: str, most: int = 3, limit: int | None = None, scene: str | None = None) -> DataFrame:
    """Takes rows in order unless their hash is within `most` bits of one taken. With a limit and a scene column, each
    pick is the first row of a scene not taken yet, or the first at all. Adds pick (from 0; null: left out)."""
    if limit is not None:
        far = lambda taken: F.forall(taken, lambda t: F.bit_count(t[bits].bitwiseXOR(F.col(bits))) > most)
        new = (lambda taken: far(taken) & F.col(scene).isNotNull() & ~F.exists(taken, lambda t: F.coalesce(t[scene] == F.col(scene), F.lit(False)))) if scene else (lambda taken: F.lit(False))
        return picks(df, keys, order, [bits, *([scene] if scene else [])], [(new, far)] * limit, "pick")
    x = numbered(df, "_place", *in_order(order))
    near = stored(near_hashes(x, "_place", bits, most, keys), "near")
    # a later row of a class is out whatever becomes of its first row: what keeps that one out keeps out both
    out = kept_out(near.filter("distance > 0").select("left_id", "right_id")).unionByName(near.filter("distance = 0").select(F.col("right_id").alias("node")))
    x = x.join(out.select(F.col("node").alias("_place")).distinct().withColumn("_out", F.lit(True)), "_place", "left")
    taken = numbered(x.filter("_out is null").select(F.struct(*keys).alias("_key"), F.col("_place").alias("_own")), "_n", F.asc("_key"), F.asc("_own"))
    taken = taken.join(taken.groupBy("_key").agg(F.min("_n").alias("_begin")), "_key").select(F.col("_own").alias("_place"), (F.col("_n") - F.col("_begin")).cast("int").alias("pick"))
    return x.drop("_out").join(taken, "_place", "left").drop("_place")


def download_budget(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], size: str, usable: str, most_items: int, most_bytes: int, most_item: int) -> DataFrame:
    """Downloads in order under caps. An item over its own cap, or over what is left, is skipped; one that proves
    unusable costs its transfer but no place; the run stops at the item count or when either ledger is full.
    Adds outcome (delivered, unusable, oversize, not_reached), delivered_bytes and transferred_bytes so far."""

    def decide(rows):
        count = delivered = moved = 0
        out, d, t = [], [], []
        for n, ok in zip(rows[size], rows[usable], strict=True):
            room = most_bytes - max(delivered, moved)
            if count >= most_items or room <= 0:
                out.append("not_reached")
            elif n > min(most_item, room):
                out.append("oversize")
            else:
                moved += n
                if ok:
                    count += 1
                    delivered += n
                out.append("delivered" if ok else "unusable")
            d.append(delivered)
            t.append(moved)
        return {"outcome": out, "delivered_bytes": d, "transferred_bytes": t}

    return fold(df, keys, order, decide, "outcome string, delivered_bytes bigint, transferred_bytes bigint")


def material_quota(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], size: str, author: str, target: int, floor: int, ceiling: int, per_author: int) -> DataFrame:
    """Takes materials in order: an author's share and the byte ceiling skip a row; reaching the target with the byte
    floor stops. Adds stage: taken, author, ceiling or stopped."""

    def decide(rows):
        taken, total, by, out = 0, 0, {}, []
        for n, a in zip(rows[size], rows[author], strict=True):
            if taken >= target and total >= floor:
                out.append("stopped")
            elif by.get(a, 0) >= per_author:
                out.append("author")
            elif total + n > ceiling:
                out.append("ceiling")
            else:
                taken, total, by[a] = taken + 1, total + n, by.get(a, 0) + 1
                out.append("taken")
        return {"stage": out}

    return fold(df, keys, order, decide, "stage string")


def main_and_support(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], author: str, source: str, seconds: str, least_seconds: float, mains: int = 2) -> DataFrame:
    """At most `mains` mains, one an author: first of different sources, then of any; if none is long enough, the first
    at all. The others support. Adds role."""
    new = lambda c: lambda taken: ~F.exists(taken, lambda t: t[c].eqNullSafe(F.col(c)))
    long = lambda taken: (F.col(seconds) >= least_seconds) & new(author)(taken)
    rounds = [(lambda taken: long(taken) & new(source)(taken), long, lambda taken: (F.col(seconds) >= 0) & new(author)(taken) & F.forall(taken, lambda t: t[seconds] < least_seconds))] * mains
    x = picks(df, keys, order, [author, source, seconds], rounds, "_main")
    return x.withColumn("role", F.when(F.col("_main").isNotNull(), "main").otherwise("support")).drop("_main")


def text_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], length: str, budget: int) -> DataFrame:
    """Lines to chunks of at most budget characters, one more for each line's end; a longer line stands alone.
    Adds chunk (from 0)."""

    def decide(rows):
        chunk = used = 0
        out = []
        for i, n in enumerate(rows[length]):
            if i and used and used + n + 1 > budget:
                chunk, used = chunk + 1, 0
            used += n + 1
            out.append(chunk)
        return {"chunk": out}

    return fold(df, keys, order, decide, "chunk int")


def merge_frames(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], at: str, gap: float = 0.12) -> DataFrame:
    """Frames within `gap` seconds of the frame that a group began with (not of the one before) are one. Adds frame."""

    def decide(rows):
        head, frame, out = None, -1, []
        for t in rows[at]:
            if head is None or t - head > gap:
                head, frame = t, frame + 1
            out.append(frame)
        return {"frame": out}

    return fold(df, keys, order, decide, "frame int")
