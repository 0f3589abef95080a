"""Row filters. Each returns a function for DataFrame.transform; Catalyst pushes them to the scan."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import dates

from .columns import Step


def keep_rows(condition: Column) -> Step:
    return lambda df: df.filter(condition)


def remove_rows(condition: Column) -> Step:
    """Rows for which the condition is unknown stay."""
    return lambda df: df.filter(~F.coalesce(condition, F.lit(False)))


def values(name: str, members: list) -> Step:
    return lambda df: df.filter(F.col(name).isin(members))


def exclude(name: str, members: list) -> Step:
    """Nulls stay."""
    return lambda df: df.filter(F.col(name).isNull() | ~F.col(name).isin(members))


def in_range(name: str, low: object = None, high: object = None) -> Step:
    """Both ends included; an end that is not given is open."""

    def run(df: DataFrame) -> DataFrame:
        df = df if low is None else df.filter(F.col(name) >= F.lit(low))
        return df if high is None else df.filter(F.col(name) <= F.lit(high))

    return run


def nulls(name: str, keep: bool = True) -> Step:
    return lambda df: df.filter(F.col(name).isNull() if keep else F.col(name).isNotNull())


def wildcard(name: str, text: str, how: str = "contains") -> Step:
    match = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith, "exact": lambda a, b: a == b}[how]
    return lambda df: df.filter(match(F.col(name), F.lit(text)))


def relative_dates(name: str, unit: str, anchor: datetime.date, last: int = 0, following: int = 0, include_anchor: bool = True) -> Step:
    """The anchor's period, `last` periods before it and `following` after it; without it if not included."""
    here = dates.trunc(unit, F.lit(anchor))
    start, end = dates.add(unit, -last, here), dates.add(unit, following + 1, here)
    day = F.to_date(F.col(name))

    def run(df: DataFrame) -> DataFrame:
        df = df.filter((day >= start) & (day < end))
        return df if include_anchor else df.filter(~((day >= here) & (day < dates.add(unit, 1, here))))

    return run


def top_members(name: str, measure: Column, n: int, descending: bool = True) -> Step:
    """Only rows of the n members with the highest (lowest) measure; ties go to the smaller member."""

    def run(df: DataFrame) -> DataFrame:
        ranked = df.groupBy(name).agg(measure.alias("\0m")).orderBy(F.desc("\0m") if descending else F.asc("\0m"), name).limit(n)
        return df.join(F.broadcast(ranked.select(name)), name, "left_semi")  # n rows

    return run


def context(first: Step, *later: Step) -> Step:
    """Filters in their defined order: the context filter before top-n and fixed aggregates, then all others."""

    def run(df: DataFrame) -> DataFrame:
        for step in (first, *later):
            df = df.transform(step)
        return df

    return run


def dataset(include: dict[str, list] | None = None, without: dict[str, list] | None = None, ranges: dict[str, tuple] | None = None) -> Step:
    """Filters declared with a dataset: members in, members out, and ranges."""

    def run(df: DataFrame) -> DataFrame:
        for c, v in (include or {}).items():
            df = df.transform(values(c, v))
        for c, v in (without or {}).items():
            df = df.transform(exclude(c, v))
        for c, (low, high) in (ranges or {}).items():
            df = df.transform(in_range(c, low, high))
        return df

    return run


def date_part(name: str, part: str, members: list[int]) -> Step:
    return lambda df: df.filter(dates.part(part, F.col(name)).isin(members))


def any_of(*conditions: Column) -> Step:
    """Union of member groups."""
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return lambda df: df.filter(out)


def group_filter(name: str, kind: str, *arguments) -> Step:
    """A filter on one field by kind: member, union, range or except."""
    make = {"member": lambda v: values(name, [v]), "union": lambda v: values(name, v), "range": lambda a, b: in_range(name, a, b), "except": lambda v: exclude(name, v)}
    return make[kind](*arguments)
