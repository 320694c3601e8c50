"""Calendar helpers: UTC wall-clock timestamps in, Berlin calendar days and buckets out.

All functions take and return TIMESTAMP_NTZ (UTC) or DATE (Berlin day).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

ZONE = "Europe/Berlin"
UNITS = ("minute", "hour", "day", "week")


def as_ts(value) -> Column:
    """Literal UTC timestamp from a datetime, an ISO text, or a column (returned as it is)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def berlin_local(c: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), c)


def to_utc(local: Column) -> Column:
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), local.cast("timestamp_ntz"))


def berlin_day(c: Column) -> Column:
    return berlin_local(c).cast("date")


def day_start(day: Column) -> Column:
    """UTC instant of 00:00 Berlin."""
    return to_utc(day)


def day_end(day: Column) -> Column:
    """UTC instant of 23:59:59 Berlin.  On 23- and 25-hour days this is the true end of the day."""
    return to_utc(F.date_add(day, 1)) - F.expr("INTERVAL 1 SECOND")


def day_spine(first: Column, last: Column) -> Column:
    """Array of all days from first to last."""
    return F.sequence(first, last, F.expr("INTERVAL 1 DAY"))


def last_days(end_day, n: int) -> Column:
    end = as_date(end_day)
    return day_spine(F.date_sub(end, n - 1), end)


def bucket(c: Column, unit: str) -> Column:
    """UTC start of the bucket.  Days and Monday weeks are Berlin days and weeks; Berlin is a whole number of hours
    away from UTC, so minutes and hours are the same in both zones."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    if unit in ("minute", "hour"):
        return F.date_trunc(unit, c).cast("timestamp_ntz")
    return to_utc(F.date_trunc(unit, berlin_local(c)).cast("timestamp_ntz"))


def bucket_spine(first: Column, last: Column, unit: str) -> Column:
    """Array of all bucket starts between two instants."""
    if unit in ("minute", "hour"):
        return F.sequence(bucket(first, unit), last, F.expr(f"INTERVAL 1 {unit}"))
    step = "INTERVAL 1 DAY" if unit == "day" else "INTERVAL 7 DAY"
    local = F.sequence(F.date_trunc(unit, berlin_local(first)).cast("timestamp_ntz"), berlin_local(last), F.expr(step))
    return F.transform(local, to_utc)


def bucket_step(unit: str) -> str:
    """Nominal length of a bucket as an interval literal."""
    return {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}[unit]


def auto_unit(first_day: dt.date, last_day: dt.date) -> str:
    """Unit for a span: up to 3 days hours, up to 45 days days, weeks beyond."""
    span = (last_day - first_day).days + 1
    return "hour" if span <= 3 else "day" if span <= 45 else "week"


def iso_week(c: Column) -> Column:
    return F.weekofyear(berlin_local(c))


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b, with fraction."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def axis_time(axis: str, published: str = "published_at", seen: str = "last_seen", first: str = "discovered_at") -> Column:
    """Time an article counts under: publication or last scan, both falling back to the first scan."""
    if axis not in ("published", "seen"):
        raise ValueError(f"unknown axis {axis!r}")
    return F.coalesce(F.col(seen if axis == "seen" else published), F.col(first))


def effective_published(published: Column, first_seen: Column) -> Column:
    """Publication time, never after the first scan."""
    return F.when(published > first_seen, first_seen).otherwise(published)


def duration_label(seconds: Column) -> Column:
    """Short German duration text: minutes, hours and minutes, days and hours."""
    mins = F.floor(seconds / 60 + F.lit(0.5)).cast("bigint")
    hours, days = F.floor(mins / 60).cast("bigint"), F.floor(mins / 1440).cast("bigint")
    rest_min, rest_h = mins % 60, hours % 24
    return (
        F.when(mins < 1, F.lit("unter 1 Min"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" Min")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit("h"), F.when(rest_min > 0, F.concat(F.lit(" "), rest_min.cast("string"), F.lit("min"))).otherwise("")))
        .otherwise(F.concat(days.cast("string"), F.lit("d"), F.when(rest_h > 0, F.concat(F.lit(" "), rest_h.cast("string"), F.lit("h"))).otherwise("")))
    )


# Date texts found in pages: with and without zone, blank or T, with and without seconds or fraction; RFC 822 in feeds.
TS_FORMATS = (
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS]XX",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm[:ss][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm[:ss][.SSSSSS][.SSS]", "yyyy-MM-dd", "yyyy/MM/dd",
)


def parse_ts(c: Column) -> Column:
    """Tolerant timestamp parser: UTC value, or NULL when no known form fits."""
    t = F.trim(c)
    # English weekday and month names are brought to a numeric form: the weekday letter is not accepted for parsing
    rfc = F.regexp_replace(t, r"^[A-Za-z]{3},\s+", "")
    month = F.regexp_extract(rfc, r"^\d{1,2}\s+([A-Za-z]{3})", 1)
    names = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
    number = F.lpad(F.array_position(F.array(*[F.lit(m) for m in names]), F.initcap(month)).cast("string"), 2, "0")
    numeric = F.concat(
        F.regexp_extract(rfc, r"(\d{4})", 1), F.lit("-"), number, F.lit("-"), F.lpad(F.regexp_extract(rfc, r"^(\d{1,2})", 1), 2, "0"),
        F.lit("T"), F.regexp_extract(rfc, r"(\d{2}:\d{2}(?::\d{2})?)", 1),
        F.regexp_replace(F.regexp_replace(F.regexp_extract(rfc, r"(GMT|UTC|Z|[+-]\d{2}:?\d{2})\s*$", 1), "^(GMT|UTC|Z)$", "+0000"), ":", ""))
    text = F.when(rfc.rlike(r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}"), numeric).otherwise(t)
    # a form that cannot fit costs an exception: it is only tried on texts that have its marks
    letter = text.contains("T") | text.contains("t")
    zone = text.rlike(r"(?i)(?:z|[+-]\d{2}:?\d{2})\z")
    blank = text.contains(" ")
    marks = (letter & zone, letter & zone, letter, blank & zone, blank, ~letter & ~blank, text.contains("/"))
    return F.coalesce(*[F.when(m, F.try_to_timestamp(text, F.lit(f))) for m, f in zip(marks, TS_FORMATS, strict=True)]).cast("timestamp_ntz")
