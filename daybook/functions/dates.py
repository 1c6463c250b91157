"""Dates and instants: parsing cascades, time-zone moves, calendar truncation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.fixed_values import FALLBACK_DATE_FORMATS

# strptime directive -> (Spark pattern letters, shape that text must have)
_DIRECTIVES = {
    "%d": ("d", r"\d{1,2}"),
    "%m": ("M", r"\d{1,2}"),
    "%Y": ("yyyy", r"\d{4}"),
    "%y": ("yy", r"\d{2}"),
    "%b": ("MMM", r"[A-Za-z]{3}"),
    "%B": ("MMMM", r"[A-Za-z]{3,9}"),
}


def spark_format(strptime_format: str) -> tuple[str, str]:
    """Translate a strptime date format to a Spark pattern and the regex of its shape."""
    pattern, shape = "", ""
    for piece in re.split(r"(%[A-Za-z])", strptime_format):
        if piece.startswith("%"):
            if piece not in _DIRECTIVES:
                raise ValueError(f"unsupported date directive {piece!r} in {strptime_format!r}")
            letters, regex = _DIRECTIVES[piece]
            pattern += letters
            shape += regex
        elif piece:
            pattern += re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", piece)
            shape += re.escape(piece)
    return pattern, f"^{shape}$"


def parse_date_as(text: Column, strptime_format: str) -> Column:
    """Parse with one format; NULL if the text has another shape or names no real day.

    The shape test comes first, so that a cascade costs a regex per format and not a
    raised and swallowed parse error per format. Two-digit years 69-99 are 19xx.
    """
    pattern, shape = spark_format(strptime_format)
    day = F.try_to_date(text, pattern)
    if re.search(r"%y", strptime_format):
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return F.when(text.rlike(shape), day)


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    """First format of the cascade that reads the text; own formats go before the fallbacks."""
    trimmed = F.trim(text)
    cascade = list(dict.fromkeys([*(formats or []), *FALLBACK_DATE_FORMATS]))
    return F.coalesce(*[parse_date_as(trimmed, f) for f in cascade])


def local_to_instant(naive: Column, tz: str) -> Column:
    """The instant at which a wall clock in ``tz`` shows ``naive`` (a date or timestamp_ntz)."""
    wall = naive.cast("timestamp_ntz").cast("string")
    return F.concat(wall, F.lit(" " + tz)).try_cast("timestamp")


def utc_wall_clock(instant: Column) -> Column:
    """UTC wall clock of an instant as timestamp_ntz, whatever the session time zone is.

    Counted from the epoch: a detour over the session zone would lose hours at DST changes.
    """
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def utc_text(ts: Column, has_zone: bool = True) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of the UTC wall clock; a zoneless column is taken to be UTC."""
    wall = utc_wall_clock(ts) if has_zone else ts
    return F.substring(wall.cast("string"), 1, 19)


def local_day(instant: Column, tz: str) -> Column:
    """Calendar day of an instant in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall_clock(instant)).cast("date")


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts).cast("date")


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def year_start(as_of: Column) -> Column:
    return F.trunc(as_of, "year")


def as_of_date(as_of: str | None) -> Column:
    """The reporting day: a given one, or today."""
    return F.to_date(F.lit(as_of)) if as_of else F.current_date()
