"""Counts and durations as they are written in exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a unit after a number multiplies it by.
UNITS = {"万": 1e4, "亿": 1e8, "k": 1e3, "m": 1e6}
_COUNT = r"^([0-9]+(?:\.[0-9]+)?)(万|亿|k|m)?$"


def parse_count(text: Column) -> Column:
    """A written count as BIGINT, null if it is none: 1,234+ is 1234, 1.2万 is 12000; fractions are cut off."""
    t = F.lower(F.regexp_replace(F.trim(text), "[,+ ]", ""))
    unit = F.regexp_extract(t, _COUNT, 2)
    factor = F.lit(1.0)
    for k, v in UNITS.items():
        factor = F.when(unit == k, F.lit(v)).otherwise(factor)
    return F.when(t.rlike(_COUNT), (F.regexp_extract(t, _COUNT, 1).try_cast("double") * factor).cast("bigint"))


def duration_seconds(millis: Column, seconds: Column) -> Column:
    """Seconds as DOUBLE: milliseconds first, else seconds, of which more than 10000 are milliseconds too."""
    ms, s = millis.try_cast("double"), seconds.try_cast("double")
    return F.coalesce(F.when(ms > 0, ms / 1000), F.when(s > 10000, s / 1000), F.when(s > 0, s))


def clock_seconds(text: Column) -> Column:
    """MM:SS or HH:MM:SS as BIGINT seconds."""
    parts = F.split(text, ":")
    return F.when(text.rlike("^[0-9]+(:[0-9]{1,2}){1,2}$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 60 + x.cast("bigint")))


def clock(seconds: Column) -> Column:
    """Seconds as MM:SS."""
    s = F.floor(seconds).cast("bigint")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def half_up(x: Column | str, digits: int) -> Column:
    """A double rounded as the double that it is: 0.5085 lies below its name, so it is 0.508 of three digits (F.round goes by the name)."""
    unit = F.lit(10.0**digits)
    return F.round((F.col(x) if isinstance(x, str) else x) * unit) / unit


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_points(value: Column, weight: float, digits: int = 3) -> Column:
    """weight times log1p(value) as a share of log1p of a million, at most the weight."""
    return half_up(F.lit(weight) * F.least(F.lit(1.0), F.log1p(F.greatest(value, F.lit(0)).cast("double")) / F.log1p(F.lit(1e6))), digits)
