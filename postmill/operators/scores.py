"""Deterministic scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.number import clamp, half_up, log_points

#: What an interaction weighs in engagement, and in heat.
ENGAGEMENT = {"likes": 1.0, "comments": 3.0, "shares": 5.0, "collects": 4.0, "plays": 0.05}
HEAT = {"likes": 22.0, "comments": 20.0, "collects": 18.0, "shares": 22.0, "freshness": 10.0, "related": 4.0, "groups": 2.0, "lanes": 2.0}


def engagement(counts: dict[str, Column] | None = None) -> Column:
    """Weighted interactions; null counts as none."""
    out = F.lit(0.0)
    for k, w in ENGAGEMENT.items():
        c = counts[k] if counts else F.col(k)
        out = out + F.coalesce(c, F.lit(0)) * F.lit(w)
    return out


def post_score(progress: Column, e: Column, median: Column, classified: Column, source_bonus: Column, missing: Column) -> Column:
    """0 to 100: freshness 10 to 25, interaction to 40, category 15, source, completeness to 5, anomaly to 15."""
    fresh = F.lit(10.0) + clamp(progress, 0.0, 1.0) * 15
    interaction = F.when(e > 0, F.least(F.lit(40.0), F.log10(F.lit(1.0) + e) * 8)).otherwise(0.0)
    quality = F.greatest(F.lit(0.0), F.lit(5.0) - missing * 1.5)
    anomaly = F.when(median > 0, clamp(F.log2(F.greatest(F.lit(1.0), e / median)) * 6, 0.0, 15.0)).otherwise(0.0)
    return half_up(F.least(F.lit(100.0), fresh + interaction + F.when(classified, 15.0).otherwise(0.0) + source_bonus + quality + anomaly), 3)


def heat(age_hours: Column, n_groups: Column, n_lanes: Column, weights: dict[str, float] | None = None) -> Column:
    """An event's heat from its effective interactions, age, source groups and lanes; terms rounded, then the sum."""
    w = weights or HEAT
    out = F.lit(0.0)
    for k in ("likes", "comments", "collects", "shares"):
        out = out + log_points(F.col(k), w[k])
    out = out + half_up(F.lit(w["freshness"]) * F.exp(-age_hours / 24.0), 3)
    out = out + half_up(F.lit(w["related"]) * F.least(F.lit(1.0), F.log1p(n_groups.cast("double")) / F.log(F.lit(11.0))), 3)
    out = out + half_up(F.lit(w["groups"]) * F.least(F.lit(1.0), n_groups / 3), 3)
    return half_up(out + F.when(n_lanes > 1, w["lanes"]).otherwise(0.0), 3)


def signal(likes: Column, comments: Column, collects: Column, shares: Column) -> Column:
    """The public signal score: 1, 2, 3 and 4 for each."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return z(likes) + 2 * z(comments) + 3 * z(collects) + 4 * z(shares)


def share_of_max(value: Column, of: Column, scale: float, digits: int) -> Column:
    """scale * value / the greatest (0 of 1 if that is 0)."""
    return half_up(F.lit(scale) * value / F.when(of == 0, 1.0).otherwise(of), digits)
