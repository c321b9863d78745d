"""Verdicts over measurements: decoding, visual, faces, speech, gates with reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.number import half_up

#: Tolerances of decode validation, face and motion thresholds.
TOLERANCE, MIN_COVERAGE, GAP_SECONDS, GAP_SHARE, SLACK_FRAMES, SLACK_SHARE = 0.05, 0.95, 1.0, 0.05, 2, 0.02
FACE_FREE, FACE_LOW = 0.05, 0.15
MOTION_DELTA, MOTION_RATIO, OCR_COVER = 0.02, 0.20, 0.40


def decode_conclusion(probed: Column, decoded: Column, expected_frames: Column, decoded_frames: Column, errors: Column) -> Column:
    """What decoding a file showed: the first of missing, undecodable, corrupt, short, deviating, or valid."""
    coverage = decoded / probed
    gap = probed - decoded
    short = (expected_frames - decoded_frames > F.greatest(F.lit(SLACK_FRAMES), SLACK_SHARE * expected_frames)) | ((coverage < MIN_COVERAGE) & (gap > F.greatest(F.lit(GAP_SECONDS), GAP_SHARE * probed)))
    return (
        F.when(probed.isNull() | (probed <= 0), "missing_duration").when(decoded_frames == 0, "undecodable").when(errors > 3, "corrupt").when(short, "short_decode")
        .when(F.abs(gap) > F.greatest(F.lit(GAP_SECONDS), TOLERANCE * probed), "duration_mismatch").otherwise("valid")
    )


def visual_verdict(motion: Column, ocr: Column) -> Column:
    """Motion or text decides; null where the text couldn't be measured and motion doesn't."""
    moving = motion >= MOTION_RATIO
    return F.when(moving, True).when(ocr.isNull(), None).otherwise(ocr >= OCR_COVER)


def face_class(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio <= FACE_FREE, "face_free").when(ratio <= FACE_LOW, "low").otherwise("high")


def speech_rate(text: Column, seconds: Column) -> Column:
    """Characters other than white space a second, of one second at least."""
    return half_up(F.length(F.regexp_replace(text, r"\s+", "")) / F.greatest(F.lit(1.0), seconds), 4)


def claim_status(facts: Column, publishers: Column) -> Column:
    """A claim's standing by its non-heat facts and independent publishers."""
    return F.when(facts == 0, "unsupported").when(publishers >= 2, "verified").otherwise("single_source")
