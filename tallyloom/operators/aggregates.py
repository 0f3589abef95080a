"""Aggregation: named measures, group steps, totals, switches and pre-aggregated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attr(x: Column | str) -> Column:
    """The one value of the group, else null."""
    return F.when(F.min(x) == F.max(x), F.min(x))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, and another value where b is zero or null."""
    out = F.try_divide(a, b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def percentile(x: Column | str, p: float, approximate: bool = False) -> Column:
    """Inclusive, interpolated; or the bounded-memory estimate."""
    return F.percentile_approx(x, p) if approximate else F.percentile(x, p)


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's, 0 where it is not defined."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    spread = F.stddev_pop(F.when(both, _c(x))) * F.stddev_pop(F.when(both, _c(y)))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def collect_points(lat: Column | str, lon: Column | str) -> Column:
    return F.collect_list(F.struct(_c(lat).alias("lat"), _c(lon).alias("lon")))


def collect_parts(df: DataFrame, keys: list[str], lat: str, lon: str, most: int = 10_000) -> DataFrame:
    """(keys, part, points): a group's points in several rows of about `most`, for groups that no row can hold.

    Rows are dealt by a hash of all their columns to as many parts as the group's count asks for: the same parts whatever
    Spark runs again. Rows equal in all columns share a part. No shuffle brings a whole group to one task: the counts of
    groups of more than `most` rows, at most one for so many rows of the table, are broadcast (left to AQE if `most` is under 1000).
    """
    counts = df.groupBy(*[F.col(k).alias("\0key_" + k) for k in keys]).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("\0parts")).filter(F.col("\0parts") > 1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("\0key_" + k)) for k in keys], F.lit(True))
    dealt = df.join(F.broadcast(counts) if most >= 1000 else counts, same, "left").withColumn("part", F.pmod(F.xxhash64(*df.columns), F.coalesce("\0parts", F.lit(1).cast("long"))))
    return dealt.groupBy(*keys, "part").agg(collect_points(lat, lon).alias("points"))


def distinct_count(x: Column | str, approximate: bool = False) -> Column:
    """Nulls do not count."""
    return F.approx_count_distinct(x) if approximate else F.count_distinct(_c(x))


def when_true(aggregate, condition: Column, x: Column) -> Column:
    """An aggregate of the rows for which a condition holds."""
    return aggregate(F.when(condition, x))


#: Aggregates by the names that flows and shelves use.
BY_NAME = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "cnt": F.count, "ctd": distinct_count, "median": F.median, "attr": attr,
    "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop, "rows": lambda _x: F.count(F.lit(1)),
}


def by_name(name: str, x: Column | str) -> Column:
    """An unknown name is an error."""
    return BY_NAME[name](_c(x))


def group(df: DataFrame, keys: list[str | Column], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def group_all(df: DataFrame) -> DataFrame:
    """Each different row with its count."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_rows(df: DataFrame, keys: list[str] | None = None, order_by: list[Column] | None = None) -> DataFrame:
    """Different rows; or per key the first in order, found by one aggregate and no sort."""
    if keys is None:
        return df.distinct()
    rest = [c for c in df.columns if c not in keys]
    order = order_by or [F.col(c) for c in rest]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(first.alias("\0first")).select(*[F.col(f"\0first.{c}") if c in rest else F.col(c) for c in df.columns])


def totals(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """The grid and a grand total, whose keys are null and is_total 1."""
    cols = [F.col(k) for k in keys]
    return df.groupingSets([cols, []], *cols).agg(*[m.alias(n) for n, m in measures.items()], F.least(F.grouping_id(), F.lit(1)).cast("int").alias("is_total"))


def subtotals(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """The grid, a subtotal for each single key, and the grand total, told apart by grouping_id."""
    cols = [F.col(k) for k in keys]
    sets = [cols, *[[c] for c in cols], []] if len(cols) > 1 else [cols, []]
    return df.groupingSets(sets, *cols).agg(*[m.alias(n) for n, m in measures.items()], F.grouping_id().cast("long").alias("grouping_id"))


def drill(df: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Roll-up along a hierarchy; level tells how many levels a row has."""
    depth = sum((1 - F.grouping(c) for c in levels), F.lit(0))
    return df.rollup(*levels).agg(*[m.alias(n) for n, m in measures.items()], depth.cast("int").alias("level"))


def date_drill(df: DataFrame, date: str, measures: dict[str, Column]) -> DataFrame:
    """Roll-up along year, quarter, month and day."""
    parts = {"year": F.year(date), "quarter": F.quarter(date), "month": F.month(date), "day": F.dayofmonth(date)}
    return drill(df.withColumns(parts), list(parts), measures)


def measure_switch(df: DataFrame, keys: list[str], measures: dict[str, Column], chosen: list[str] | None = None) -> DataFrame:
    """One grid with a row for each measure: (keys, measure, value)."""
    grid = group(df, keys, {n: m.cast("double") for n, m in measures.items() if chosen is None or n in chosen})
    return grid.unpivot(keys, [n for n in measures if chosen is None or n in chosen], "measure", "value")


def dimension_switch(df: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures by each of several dimensions in one pass: (dimension, member, measures)."""
    cols = [F.col(d) for d in dimensions]
    name = reduce(lambda out, d: out.when(F.grouping(d) == 0, d), dimensions, F)
    member = F.coalesce(*[F.col(d).cast("string") for d in dimensions])
    sets = df.groupingSets([[c] for c in cols], *cols).agg(name.alias("dimension"), *[m.alias(n) for n, m in measures.items()])
    return sets.select("dimension", member.alias("member"), *measures)


def what_if(df: DataFrame, name: str, values: list[float], measures: dict[str, Column]) -> DataFrame:
    """A row for each value of a parameter with the measures beside it, to be combined with select(); rows are read once."""
    table = df.sparkSession.createDataFrame([(float(v),) for v in values], f"`{name}` double")
    grid = df.agg(*[m.alias(n) for n, m in measures.items()])  # one row
    return table.crossJoin(grid)


def parameter_range(spark, name: str, start: float, stop: float, step: float) -> DataFrame:
    n = int((stop - start) / step + 1e-9) + 1
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * float(step)).alias(name))


class Cube:
    """A pre-aggregated table whose sums, counts and extremes answer coarser questions, as do sketches of distinct values.

    Sums of sums are exact. Distinct counts do not add up, so each cell keeps a sketch of its values: HyperLogLog for
    counts (relative standard error 1.04 / sqrt(2^log_size), 1.6 % at 12), and theta for counts of values that cells share or lack
    (1 / sqrt(2^log_size)). A cell's sketch is bounded by its size, whatever it counts.
    """

    def __init__(self, table: DataFrame, keys: list[str], values: list[str], distinct: list[str] = ()):
        self.table, self.keys, self.values, self.distinct = table, keys, values, list(distinct)

    @classmethod
    def build(cls, df: DataFrame, keys: list[str], values: list[str], distinct: list[str] = (), log_size: int = 12) -> Cube:
        aggs = [a for v in values for a in (F.sum(v).alias(f"{v}_sum"), F.count(v).alias(f"{v}_count"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))]
        aggs += [a for d in distinct for a in (F.hll_sketch_agg(d, log_size).alias(f"{d}_hll"), F.theta_sketch_agg(d, log_size).alias(f"{d}_theta"))]
        return cls(df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("rows")), keys, values, distinct)

    def _known(self, keys: list[str]) -> None:
        if not set(keys) <= set(self.keys):
            raise ValueError(f"the table has no {sorted(set(keys) - set(self.keys))}")

    def ask(self, keys: list[str]) -> DataFrame:
        """The same measures, averages, and distinct counts (estimates), by some of the keys."""
        self._known(keys)
        out = [F.sum("rows").alias("rows")]
        for v in self.values:
            out += [F.sum(f"{v}_sum").alias(f"{v}_sum"), F.sum(f"{v}_count").alias(f"{v}_count"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max"), F.try_divide(F.sum(f"{v}_sum"), F.sum(f"{v}_count")).alias(f"{v}_avg")]
        out += [F.hll_sketch_estimate(F.hll_union_agg(f"{d}_hll")).alias(f"{d}_distinct") for d in self.distinct]
        return self.table.groupBy(*keys).agg(*out)

    def shared(self, keys: list[str], name: str, one: Column, other: Column) -> DataFrame:
        """(keys, either, both, only_one) by some of the keys: estimates of the different values of `name` in cells of either
        kind, in cells of both kinds and in those of the first only."""
        self._known(keys)
        sides = self.table.groupBy(*keys).agg(*[F.theta_union_agg(F.when(c, F.col(f"{name}_theta"))).alias(s) for c, s in ((one, "\0a"), (other, "\0b"))])
        size = F.theta_sketch_estimate
        return sides.select(*keys, size(F.theta_union("\0a", "\0b")).alias("either"), size(F.theta_intersection("\0a", "\0b")).alias("both"), size(F.theta_difference("\0a", "\0b")).alias("only_one"))


def validation_grid(df: DataFrame, dimension: str, measures: dict[str, Column]) -> DataFrame:
    """Every measure by one dimension, in its order."""
    return group(df, [dimension], measures).orderBy(dimension)
