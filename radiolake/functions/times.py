"""Wall-clock time helpers that never consult the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_floor(col) -> Column:
    return _c(col).cast("date").cast("timestamp_ntz")


def hour_floor(col) -> Column:
    c = _c(col)
    return day_floor(c) + F.make_dt_interval(F.lit(0), F.hour(c))


def epoch_seconds(col) -> Column:
    c = _c(col)
    return (F.unix_date(c.cast("date")).cast("bigint") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))


def plus_hours(col, hours) -> Column:
    """The time moved by whole or fractional hours (a number or a column)."""
    h = hours if isinstance(hours, Column) else F.lit(float(hours))
    return _c(col) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                        (h * 3600).cast("decimal(18,6)"))


def local_time(col) -> Column:
    """Export times carry a trailing Z although the digits are local: drop it.

    Year-first and day-first dates, with or without seconds, are put in one form and parsed
    once as a time without a zone.
    """
    text = F.regexp_replace(F.trim(_c(col).cast("string")), "[zZ]$", "")
    text = F.regexp_replace(text, r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})", "$3-$2-$1")
    text = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\S+[ T]\d{1,2}:\d{1,2})$", "$1:00")
    return text.try_cast("timestamp_ntz")


def in_period(col, first_day, last_day) -> Column:
    """Both days whole."""
    c = _c(col)
    lo = F.lit(str(first_day)).cast("date").cast("timestamp_ntz")
    hi = F.date_add(F.lit(str(last_day)).cast("date"), 1).cast("timestamp_ntz")
    return (c >= lo) & (c < hi)
