"""Calendars and time intelligence. Measures are summed to days or months first and set on a dense calendar."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first_year: int = 2020, last_year: int = 2030) -> DataFrame:
    """One row a day: Date, Year, Quarter (Q1), Month, MonthName, Day, DayOfWeek (Monday is 1), DayName."""
    days = (datetime.date(last_year, 12, 31) - datetime.date(first_year, 1, 1)).days + 1
    d = F.date_add(F.lit(datetime.date(first_year, 1, 1)), F.col("id").cast("int"))
    dates = spark.range(days).select(d.alias("Date"))
    return dates.select("Date", F.year("Date").alias("Year"), F.concat(F.lit("Q"), F.quarter("Date")).alias("Quarter"), F.month("Date").alias("Month"), F.date_format("Date", "MMMM").alias("MonthName"), F.dayofmonth("Date").alias("Day"), (F.weekday("Date") + 1).alias("DayOfWeek"), F.date_format("Date", "EEEE").alias("DayName"))


def attach(df: DataFrame, cal: DataFrame, date: str) -> DataFrame:
    """The calendar's columns beside each row, by the day of `date`."""
    return df.join(cal, F.to_date(F.col(date)) == F.col("Date"), "left")


def cadence(grain: str, date: Column) -> Column:
    """Start of a metric's period: day, week (Monday), month, quarter or year."""
    return F.to_date(F.date_trunc(grain, date))


def dense(df: DataFrame, date: str, dims: list[str], measure: Column | dict[str, Column], grain: str = "month", name: str = "value") -> DataFrame:
    """A measure, or several by name, by period and dims, with a row (null) for every period between the first and the last of each dims."""
    measures = measure if isinstance(measure, dict) else {name: measure}
    grid = df.groupBy(*dims, cadence(grain, F.col(date)).alias("period")).agg(*[m.alias(n) for n, m in measures.items()])
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[grain]
    edges = grid.groupBy(*dims).agg(F.min("period").alias("\0lo"), F.max("period").alias("\0hi"))
    periods = edges.select(*dims, F.explode(F.sequence("\0lo", "\0hi", F.expr(step))).alias("period"))
    named = grid.withColumnsRenamed({k: "\0key_" + k for k in (*dims, "period")})
    same = F.lit(True)
    for k in (*dims, "period"):
        same = same & F.col(k).eqNullSafe(F.col("\0key_" + k))
    return periods.join(named, same, "left").drop(*["\0key_" + k for k in (*dims, "period")])


def to_date_total(grid: DataFrame, dims: list[str], within: str = "year", name: str = "value", new: str = "ytd") -> DataFrame:
    """Running sum from the start of the year, quarter or month."""
    w = Window.partitionBy(*dims, F.date_trunc(within, "period")).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(new, F.sum(name).over(w))


def shifted(grid: DataFrame, dims: list[str], months: int, name: str = "value", new: str = "prior") -> DataFrame:
    """The value `months` before (after, if negative): a join on the moved period, so gaps stay gaps."""
    moved = grid.select(*dims, F.add_months("period", months).alias("period"), F.col(name).alias(new))
    moved = moved.groupBy(*dims, "period").agg(F.max(new).alias(new))  # February 29 and 28 fall together
    return grid.join(moved, [*dims, "period"], "left")


def year_over_year(grid: DataFrame, dims: list[str], name: str = "value") -> DataFrame:
    """Prior year's value and the change against it."""
    out = shifted(grid, dims, 12, name, f"{name}_py")
    return out.withColumn(f"{name}_yoy", F.try_divide(F.col(name) - F.col(f"{name}_py"), F.col(f"{name}_py")))


def standard_set(df: DataFrame, date: str, dims: list[str], measures: dict[str, Column], grain: str = "month") -> DataFrame:
    """Each measure with its year to date, prior year and year over year, in one table by dims and period.

    One scan and one dense grid for all measures; one window gives all years to date and one join all prior years.
    """
    names = list(measures)
    grid = dense(df, date, dims, measures, grain)
    w = Window.partitionBy(*dims, F.date_trunc("year", "period")).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    totals = grid.withColumns({f"{n}_ytd": F.sum(n).over(w) for n in names})
    moved = grid.groupBy(*[F.col(d).alias("\0key_" + d) for d in dims], F.add_months("period", 12).alias("\0key_period")).agg(*[F.max(n).alias(f"{n}_py") for n in names])
    same = F.lit(True)
    for k in (*dims, "period"):
        same = same & F.col(k).eqNullSafe(F.col("\0key_" + k))
    beside = totals.join(moved, same, "left")
    yoy = {n: F.try_divide(F.col(n) - F.col(f"{n}_py"), F.col(f"{n}_py")) for n in names}
    return beside.select(*dims, "period", *[c for n in names for c in (F.col(n), F.col(f"{n}_ytd"), F.col(f"{n}_py"), yoy[n].alias(f"{n}_yoy"))])


def between(grid: DataFrame, anchor: datetime.date, months: int) -> DataFrame:
    """The periods of the `months` before an anchor, the anchor's own included."""
    return grid.filter(F.col("period").between(F.add_months(F.lit(anchor), -months + 1), F.lit(anchor)))


def balances(df: DataFrame, date: str, dims: list[str], value: str, grain: str = "month") -> DataFrame:
    """First and last value of each period; of several on one day, the larger."""
    at = F.struct(F.to_date(date), value)
    grid = df.groupBy(*dims, cadence(grain, F.col(date)).alias("period"))
    return grid.agg(F.min_by(F.col(value), F.struct(F.to_date(date), -F.col(value))).alias("opening"), F.max_by(F.col(value), at).alias("closing"))
