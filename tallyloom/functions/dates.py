"""Date and time calculations, Column -> Column. Weeks start on Sunday unless said otherwise."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months in the parts that are made of months, and days or seconds in the others.
MONTHS = {"year": 12, "quarter": 3, "month": 1}
DAYS = {"week": 7, "day": 1}
SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def trunc(part: str, d: Column) -> Column:
    """Start of the period: a date for day and longer, a timestamp for shorter parts."""
    if part == "week":
        return F.date_sub(F.to_date(d), F.dayofweek(d) - 1)
    cut = F.date_trunc(part, d)
    return cut if part in SECONDS else F.to_date(cut)


def part(name: str, d: Column) -> Column:
    """A part as a number; week 1 holds January 1, weekday 1 is Sunday."""
    if name == "week":
        return (F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2) / 7) + 1).cast("int")
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.dayofweek, "dayofyear": F.dayofyear, "isoweek": F.weekofyear}
    return parts[name](d)


def name(part_name: str, d: Column) -> Column:
    """A part as text: month and weekday by their English names."""
    if part_name in ("month", "weekday"):
        return F.date_format(d, "MMMM" if part_name == "month" else "EEEE")
    return part(part_name, d).cast("string")


def add(part_name: str, n: int, d: Column) -> Column:
    """Move by n periods; months end on the last day where the day does not exist. Short parts give timestamps."""
    if part_name in MONTHS:
        return F.add_months(d, n * MONTHS[part_name])
    if part_name in DAYS:
        return F.date_add(d, n * DAYS[part_name])
    return d + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * SECONDS[part_name]))


def diff(part_name: str, start: Column, end: Column) -> Column:
    """How many period boundaries lie between, as a whole number."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    if part_name == "year":
        return (F.year(end) - F.year(start)).cast("long")
    if part_name == "quarter":
        return ((F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)).cast("long")
    if part_name == "month":
        return months.cast("long")
    if part_name in DAYS:
        return (F.datediff(trunc(part_name, end), trunc(part_name, start)) / DAYS[part_name]).cast("long")
    seconds = lambda d: F.unix_seconds(F.date_trunc(part_name, d).cast("timestamp"))
    return ((seconds(end) - seconds(start)) / SECONDS[part_name]).cast("long")


def parse(s: Column, pattern: str) -> Column:
    """A timestamp, null where the text does not fit."""
    return F.try_to_timestamp(s, F.lit(pattern))


def is_date(s: Column) -> Column:
    return F.try_to_date(s).isNotNull()


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def make_datetime(d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), h, mi, s)


def make_time(h: Column, mi: Column, s: Column) -> Column:
    """Time of day as an interval."""
    return F.make_dt_interval(F.lit(0), h, mi, s)


def today(as_of: datetime.date | None = None) -> Column:
    return F.lit(as_of) if as_of else F.current_date()


def now(as_of: datetime.datetime | None = None) -> Column:
    return F.lit(as_of) if as_of else F.current_timestamp()


def literal(iso: str) -> Column:
    return F.lit(datetime.date.fromisoformat(iso))
