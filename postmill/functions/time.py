"""Published times in all the forms that sources give, and business windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_published(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds, epoch milliseconds (numbers above 1e10), ISO with an offset, or ISO local to a zone; else null."""
    t = F.trim(text)
    n = t.try_cast("bigint")
    epoch = F.timestamp_seconds(F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n))
    local = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(t, "T", " ")), zone)
    aware = F.try_to_timestamp(t)
    return F.when(t.rlike("^[0-9]{1,18}$"), epoch).when(t.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & t.rlike("[T ][0-9]{2}:"), aware).when(t.rlike("^[0-9]{4}-"), local)


def parse_feed_date(text: Column) -> Column:
    """ISO, else RFC 822 (Mon, 02 Jan 2006 15:04:05 +0800)."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")
    rfc = F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss zzz")))
    return F.coalesce(F.try_to_timestamp(F.trim(text)), rfc)


def parse_listing_date(text: Column) -> Column:
    """The first date in a text: 2024-01-31 (or with / or .), 2024年1月31日, January 31, 2024."""
    iso = [F.regexp_extract(text, r"(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", i) for i in (1, 2, 3)]
    cjk = [F.regexp_extract(text, r"(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日", i) for i in (1, 2, 3)]
    pattern = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? ([0-9]{1,2}),? (20[0-9]{2})"
    eng = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    ymd = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    english = F.try_to_date(F.concat_ws(" ", eng[0], F.lpad(eng[1], 2, "0"), eng[2]), "MMM dd yyyy")
    return F.coalesce(ymd(*iso), ymd(*cjk), english)


def iso_local(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """The instant as ISO text with seconds in a zone without daylight saving time."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss")


def in_day(ts: Column, day: Column | str) -> Column:
    """Whether a time is in [day, next day)."""
    return F.to_date(ts) == (F.to_date(F.lit(day)) if isinstance(day, str) else day)


def hours_before(ts: Column, end: Column, low: float, high: float) -> Column:
    """Hours from ts to end, clamped."""
    h = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(3.6e9)
    return F.least(F.greatest(h, F.lit(low)), F.lit(high))


def day_end(ts: Column) -> Column:
    """23:59:59 of the day of ts."""
    return F.date_trunc("day", ts.cast("timestamp")) + F.expr("interval 86399 seconds")
