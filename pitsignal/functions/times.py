"""Column functions on dates and times. Session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitsignal.layouts import MONTHS_ES, SITE_ZONE

_DAY_FIRST = [
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy",
    "d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yyyy",
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_fixed(c: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    """Text in one exact pattern to naive UTC; anything else is null."""
    return F.try_to_timestamp(col(c), F.lit(pattern)).cast("timestamp_ntz")


def parse_iso(c: str | Column) -> Column:
    """ISO-like text, with or without an offset, to naive UTC; bad text is null."""
    return F.try_to_timestamp(col(c)).cast("timestamp_ntz")


def parse_day_first(c: str | Column) -> Column:
    """Day-before-month text, then ISO text; bad text is null."""
    tries = [F.try_to_timestamp(col(c), F.lit(p)) for p in _DAY_FIRST]
    return F.coalesce(*tries, F.try_to_timestamp(col(c))).cast("timestamp_ntz")


def to_site_time(c: str | Column, zone: str = SITE_ZONE) -> Column:
    """UTC to the wall clock of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(c))


def time_of_day(c: str | Column) -> Column:
    return F.date_format(col(c), "HH:mm:ss")


def replace_clock(day: str | Column, clock: str | Column) -> Column:
    """The date of one timestamp with the hour, minute and second of another."""
    d, t = col(day), col(clock)
    return F.make_timestamp_ntz(
        F.year(d), F.month(d), F.day(d), F.hour(t), F.minute(t), F.floor(F.second(t))
    )


def at_time(day: str | Column, clock_text: str | Column) -> Column:
    """A date and an ``HH:mm:ss`` text to one timestamp; bad text is null."""
    text = F.concat_ws(" ", F.date_format(col(day), "yyyy-MM-dd"), col(clock_text))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(col(clock_text).isNotNull(), parsed).cast("timestamp_ntz")


def month_name_es(c: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS_ES]), F.month(col(c)))


def year_month(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c: str | Column) -> Column:
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def bucket_start(c: str | Column, step_seconds: int, origin: Column | None = None) -> Column:
    """Start of the fixed-length bucket holding a time, counted from ``origin``.

    Without an origin buckets count from midnight, which needs a step that divides
    a day; any other step must be given the first midnight of the data.
    """
    step = F.lit(step_seconds * 1_000_000).cast("bigint")
    m = micros(c)
    if origin is None:
        return from_micros(m - F.pmod(m, step))
    base = micros(origin)
    return from_micros(base + (m - base) - F.pmod(m - base, step))


def add_days(c: str | Column, days: int = 1) -> Column:
    return col(c) + F.make_dt_interval(F.lit(days))
