"""Level-of-detail aggregates. Aggregates that windows cannot take, such as distinct counts, are joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """Every row with aggregates at the given dimensions, whatever the view; no dimensions: of the whole table.

    A grouped aggregate and a join on the dimensions, null-safe: the small side is shuffled or broadcast as
    AQE finds its size, and no group is held in one task as a window would.
    """
    if not dims:
        return df.crossJoin(df.agg(*[m.alias(n) for n, m in measures.items()]))  # one row
    grouped = df.groupBy(*[F.col(d).alias("\0" + d) for d in dims]).agg(*[m.alias(n) for n, m in measures.items()])
    on = [F.col(d).eqNullSafe(F.col("\0" + d)) for d in dims]
    return df.join(grouped, on, "left").drop(*["\0" + d for d in dims])


def include(df: DataFrame, view: list[str], dims: list[str], inner: dict[str, Column], outer: dict[str, Column]) -> DataFrame:
    """Aggregate at view + dims, then aggregate those to the view."""
    fine = df.groupBy(*view, *dims).agg(*[m.alias(n) for n, m in inner.items()])
    return fine.groupBy(*view).agg(*[m.alias(n) for n, m in outer.items()])


def exclude(df: DataFrame, view: list[str], dims: list[str], measures: dict[str, Column], coarse: dict[str, Column]) -> DataFrame:
    """The view's measures, with `coarse` ones aggregated as if `dims` were not in the view."""
    grid = df.groupBy(*view).agg(*[m.alias(n) for n, m in measures.items()])
    rest = [v for v in view if v not in dims]
    if not rest:
        return grid.crossJoin(df.agg(*[m.alias(n) for n, m in coarse.items()]))  # one row
    wide = df.groupBy(*[F.col(v).alias("\0" + v) for v in rest]).agg(*[m.alias(n) for n, m in coarse.items()])
    return grid.join(wide, [F.col(v).eqNullSafe(F.col("\0" + v)) for v in rest], "left").drop(*["\0" + v for v in rest])


def over(df: DataFrame, view: list[str], dims: list[str], inner: dict[str, Column], outer: dict[str, Column]) -> DataFrame:
    """An outer aggregate by view over values fixed at `dims`: each of them counts once in its view."""
    return include(df, view, [d for d in dims if d not in view], inner, outer)
