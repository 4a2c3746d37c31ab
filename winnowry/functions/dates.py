"""Dates in titles, durations in text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates of records are in this zone.
OFFSET_HOURS = 8
# The date patterns, in the order they are tried.
FULL = r"(20\d{2})[-_/.年](\d{1,2})[-_/.月](\d{1,2})"
JOINED = r"(20\d{2})(\d{2})(\d{2})"
SHORT = r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)"
MONTH_DAY = r"(\d{1,2})月(\d{1,2})[日号]"
PLAN = r"(20\d{2})[-/年.](\d{1,2})[-/月.](\d{1,2})"


def parse_duration(value: Column) -> Column:
    """Seconds of 'HH:MM:SS', 'MM:SS' or digits; 0 for anything else."""
    parts = F.aggregate(F.split(value, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long"))
    return F.coalesce(parts, F.lit(0).cast("long"))


def _at(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, null where the calendar has none."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def local_date(epoch: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((epoch + OFFSET_HOURS * 3600) / 86400).cast("int"))


def stream_date(title: Column, pubdate: Column, this_year: Column | None = None) -> Column:
    """The date a title names, tried by four patterns; one that the calendar hasn't falls through to the next.
    The year of a month and day is that of pubdate, or ``this_year`` where pubdate is 0 or null."""
    year = F.when(F.coalesce(pubdate, F.lit(0)) != 0, F.year(local_date(pubdate))).otherwise(F.year(F.current_date()) if this_year is None else this_year)
    full, joined = (_date(_at(title, p, 1), _at(title, p, 2), _at(title, p, 3)) for p in (FULL, JOINED))
    short = _date(F.concat(F.lit("20"), _at(title, SHORT, 1)), _at(title, SHORT, 2), _at(title, SHORT, 3))
    month_day = _date(year.cast("string"), _at(title, MONTH_DAY, 1), _at(title, MONTH_DAY, 2))
    return F.coalesce(full, joined, short, month_day)


def plan_date(title: Column) -> Column:
    """yyyy-mm-dd from one pattern, not checked against the calendar."""
    return F.when(title.rlike(PLAN), F.concat_ws("-", _at(title, PLAN, 1), F.lpad(_at(title, PLAN, 2), 2, "0"), F.lpad(_at(title, PLAN, 3), 2, "0")))


def record_date(title: Column, pubdate: Column) -> Column:
    return F.coalesce(stream_date(title, pubdate), F.when(pubdate > 0, local_date(pubdate)))
