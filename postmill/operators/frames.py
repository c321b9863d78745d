"""Frames of sampled clips and the boxes found in them, which belong together by their place in two arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.number import half_up

#: A box's least share of its frame; greatest shares of hit frames of a free and of a low clip; the share
#: of the expected frames below which a sample says nothing about its clip.
LEAST_AREA, FREE, LOW, ENOUGH = 0.015, 0.05, 0.15, 0.5


def frame_hits(frames: Column, detections: Column, least: float = LEAST_AREA) -> Column:
    """A boolean for each of the frames (array of w, h): whether one of its boxes (array of arrays of w, h, at the same
    place) takes up enough of it. Frames without a place in detections have no hit; places without a frame are left out
    (see uneven())."""
    area = lambda x, low: F.greatest(x["w"].cast("double"), F.lit(low)) * F.greatest(x["h"].cast("double"), F.lit(low))
    one = lambda z: F.coalesce(F.exists(z["boxes"], lambda b: area(b, 0.0) / area(z["frame"], 1.0) >= least), F.lit(False))
    return F.transform(F.slice(F.arrays_zip(frames.alias("frame"), detections.alias("boxes")), 1, F.size(frames)), one)


def uneven(frames: Column, detections: Column) -> Column:
    """A violation: more or fewer lists of boxes than frames."""
    return F.size(frames) != F.size(detections)


def hit_ratio(hits: Column) -> Column:
    """The share of hit frames; null without frames."""
    return F.when(F.size(hits) > 0, F.size(F.filter(hits, lambda h: h)) / F.size(hits))


def clip_class(ratio: Column) -> Column:
    """face_free, low_face or face_heavy by the share of hit frames; unavailable without one."""
    return F.when(ratio.isNull(), "unavailable").when(ratio <= FREE, "face_free").when(ratio <= LOW, "low_face").otherwise("face_heavy")


def with_sample_check(x, truncated: str, expected: str, emitted: str):
    """A truncated sample of under ENOUGH of the expected frames makes `class` unavailable, gives `reason` where there is
    none, sets low_confidence and tells its sample_coverage. Any other row stays as it is."""
    n, most = F.coalesce(F.col(emitted).cast("bigint"), F.lit(0)), F.coalesce(F.col(expected).cast("bigint"), F.lit(0))
    cut = F.coalesce(F.col(truncated), F.lit(False)) & (most > 0) & (n < most * ENOUGH)
    given = F.when(F.coalesce(F.col("reason"), F.lit("")) != "", F.col("reason"))
    return x.withColumns({
        "class": F.when(cut, "unavailable").otherwise(F.col("class")),
        "reason": F.when(cut, F.coalesce(given, F.lit("sample_truncated"))).otherwise(F.col("reason")),
        "low_confidence": F.when(cut, True).otherwise(F.col("low_confidence")),
        "sample_coverage": F.when(cut, half_up(n / most, 6)).otherwise(F.col("sample_coverage")),
    })
