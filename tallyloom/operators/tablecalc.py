"""Table calculations: windows over a view. Aggregate to the view first; then a partition is a pane, not the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scans


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Spec:
    """Addressing: what partitions, what orders (columns, descending with a leading minus), and what breaks ties."""

    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    match_by: tuple[str, ...] = field(default=())

    def keys(self, backwards: bool = False) -> list[Column]:
        return [F.col(k.removeprefix("-")).desc() if k.startswith("-") != backwards else F.col(k.removeprefix("-")).asc() for k in (*self.order_by, *self.match_by)]

    def pane(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_by)

    def ordered(self) -> WindowSpec:
        return self.pane().orderBy(*self.keys())

    def rows(self, first: int | None, last: int | None) -> WindowSpec:
        """Rows from offset `first` to offset `last`; None is the pane's edge.

        A frame that reaches to the end is taken in backward order: Spark grows such a frame row by row, while it
        would add up one that shrinks anew for each row.
        """
        if first is not None and last is None:
            return self.pane().orderBy(*self.keys(backwards=True)).rowsBetween(Window.unboundedPreceding, -first)
        return self.ordered().rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)


def spec(compute_using: list[str] = (), order_by: list[str] | None = None, partition_by: list[str] | None = None, match_by: list[str] = ()) -> Spec:
    """compute_using: the first orders, the rest partition; order_by and partition_by override."""
    using = list(compute_using)
    return Spec(tuple(using[1:] if partition_by is None else partition_by), tuple(using[:1] if order_by is None else order_by), tuple(match_by))


#: Window aggregates by name.
WINDOW = {
    "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count, "median": lambda x: F.percentile(x, 0.5), "stdev": F.stddev_samp,
    "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop, "covar": F.covar_samp, "covarp": F.covar_pop,
}


def window(name: str, s: Spec, *x: Column | str, first: int | None = None, last: int | None = None) -> Column:
    """An aggregate over the pane, or over rows `first` to `last` if either is given."""
    frame = s.pane() if first is None and last is None else s.rows(first, last)
    if name == "corr":  # null where it is not defined, which F.corr takes for an error
        a, b = map(_c, x)
        both = a.isNotNull() & b.isNotNull()
        spread = F.stddev_pop(F.when(both, a)).over(frame) * F.stddev_pop(F.when(both, b)).over(frame)
        return F.try_divide(F.covar_pop(a, b).over(frame), spread)
    return WINDOW[name](*[_c(v) for v in x]).over(frame)


def window_percentile(s: Spec, x: Column | str, p: float) -> Column:
    return F.percentile(_c(x), p).over(s.pane())


def running(name: str, s: Spec, x: Column | str) -> Column:
    """From the pane's first row to this one."""
    return WINDOW[name](_c(x)).over(s.rows(None, 0))


def moving_avg(s: Spec, x: Column | str, n: int) -> Column:
    """Of this row and the n - 1 before."""
    return F.avg(_c(x)).over(s.rows(-n + 1, 0))


def rank(s: Spec, x: Column | str, kind: str = "competition", order: str = "desc") -> Column:
    """competition 1,2,2,4; dense 1,2,2,3; unique 1,2,3,4 by the tie keys; modified 1,3,3,4; percentile 0..1."""
    by = _c(x).desc() if order == "desc" else _c(x).asc()
    w = s.pane().orderBy(by)
    if kind == "unique":
        return F.row_number().over(s.pane().orderBy(by, *s.keys()))
    if kind == "modified":
        return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return {"competition": F.rank, "dense": F.dense_rank, "percentile": F.percent_rank}[kind]().over(w)


def index(s: Spec) -> Column:
    return F.row_number().over(s.ordered())


def first(s: Spec) -> Column:
    """Offset to the pane's first row, zero or below."""
    return 1 - F.row_number().over(s.ordered())


def last(s: Spec) -> Column:
    """Offset to the pane's last row, zero or above."""
    return F.count(F.lit(1)).over(s.pane()) - F.row_number().over(s.ordered())


def size(s: Spec) -> Column:
    return F.count(F.lit(1)).over(s.pane())


def lookup(s: Spec, x: Column | str, offset: int) -> Column:
    return (F.lead(_c(x), offset) if offset >= 0 else F.lag(_c(x), -offset)).over(s.ordered())


def previous_value(df: DataFrame, s: Spec, new: str, start: float, step: Callable[[Column, dict[str, Column]], Column]) -> DataFrame:
    """new = step(new in the previous row of the pane, this row's columns), starting from `start`: true recursion.

    step takes and gives Columns and is linear in the previous value, so steps compose and panes of any size are split
    (see scans.recursion); one that is not linear raises an error on the row that shows it. Use folded() for those.
    """
    row = {c: F.col(c) for c in df.columns}
    at = lambda x: step(F.lit(float(x)), row).cast("double")
    added, factor = at(0), at(1) - at(0)
    straight = F.abs(at(3) - (3 * factor + added)) <= 1e-9 * F.greatest(F.abs(at(3)), F.abs(added), F.abs(factor), F.lit(1.0))
    checked = F.when(straight | at(3).isNull(), added).otherwise(F.raise_error(F.lit("the step is not linear in the previous value")).cast("double"))
    return scans.recursion(df, new, start, factor, checked, s.keys(), list(s.partition_by))


def folded(df: DataFrame, s: Spec, new: str, start: float, step: Callable[[float, dict], float]) -> DataFrame:
    """As previous_value(), for any Python function of the previous value and the row as a dict.

    A pane streams through one task in order, batch by batch: its size is bounded by time, not memory.
    """
    panes = [F.col(p) for p in s.partition_by] or [F.lit(0)]
    sorted_ = df.withColumn("\0pane", F.to_json(F.struct(*panes), {"ignoreNullFields": "false"})).repartition("\0pane").sortWithinPartitions("\0pane", *s.keys())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x = None, start
        for b in batches:
            out, panes = [], b["\0pane"]
            rows = b.drop(columns="\0pane")
            for pane, values in zip(panes, rows.to_dict("records"), strict=True):
                at, x = pane, step(start if pane != at else x, values)
                out.append(x)
            yield rows.assign(**{new: pd.Series(out, index=rows.index, dtype=float)})

    kinds = T.StructType([*df.schema.fields, T.StructField(new, T.DoubleType())])
    return sorted_.mapInPandas(run, kinds)


def running_all(df: DataFrame, s: Spec, measures: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """Running aggregates {new: (sum, count, min, max or last, value)} over panes too large for a task, such as a whole table."""
    return scans.scan(df, measures, s.keys(), list(s.partition_by))


def total(base: DataFrame, view: DataFrame, partition_by: list[str], measures: dict[str, Column]) -> DataFrame:
    """The view with aggregates of the base rows of its pane, not of the view's rows."""
    if not partition_by:
        return view.crossJoin(base.agg(*[m.alias(n) for n, m in measures.items()]))  # one row
    panes = base.groupBy(*[F.col(p).alias("\0" + p) for p in partition_by]).agg(*[m.alias(n) for n, m in measures.items()])
    return view.join(panes, [F.col(p).eqNullSafe(F.col("\0" + p)) for p in partition_by], "left").drop(*["\0" + p for p in partition_by])


def percent_of_total(s: Spec, x: Column | str) -> Column:
    return F.try_divide(_c(x), F.sum(_c(x)).over(s.pane()))


def difference(s: Spec, x: Column | str) -> Column:
    """From the previous row."""
    return _c(x) - F.lag(_c(x)).over(s.ordered())


def percent_difference(s: Spec, x: Column | str) -> Column:
    before = F.lag(_c(x)).over(s.ordered())
    return F.try_divide(_c(x) - before, before)
