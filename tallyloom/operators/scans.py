"""Prefix scans over panes of any size, a whole table among them: rows are dealt out by ranges of their order, each part is
scanned on its own, its summary is carried over to the parts behind it, and the carries are joined back.

A part boundary cuts one pane at most, so there are fewer carries than parts, whatever the number of panes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyloom.shared import settled

PART, ROW = "\0part", "\0row"


def ordered_parts(df: DataFrame, order: list[Column], partition_by: list[str] = ()) -> DataFrame:
    """The rows with part (a range of pane, then order) and row (the place within the part), written once.

    Rows that tie in pane and order share a part and keep an arbitrary but settled order.
    """
    keys = [*[F.col(p).asc() for p in partition_by], *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = settled(ranged.withColumn(PART, F.spark_partition_id()).withColumn(ROW, F.monotonically_increasing_id()))
    return marked.withColumn(ROW, F.col(ROW) - F.col(PART).cast("long") * (1 << 33))


def _cut(parts: DataFrame, partition_by: list[str], summary: dict[str, Column]) -> DataFrame:
    """(part, keys, summary) of the panes that go on in a later part: of each part its last pane, if the next part begins with it.

    The window over parts has one row for each end of a part.
    """
    keys = list(partition_by)
    each = parts.groupBy(PART, *keys).agg(F.max(ROW).alias("\0end"), *[s.alias(c) for c, s in summary.items()])
    spans = each.groupBy(*keys).agg(F.min(PART).alias("\0first"), F.max(PART).alias("\0last")) if keys else each.agg(F.min(PART).alias("\0first"), F.max(PART).alias("\0last"))
    wide = spans.filter("`\0first` < `\0last`")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("\0key_" + k))
    return each.join(wide.withColumnsRenamed({k: "\0key_" + k for k in keys}), same).drop("\0end", "\0first", "\0last", *["\0key_" + k for k in keys])


#: Running aggregates by name: within a part, the part's summary, how summaries add up, and how a carry meets a value.
_SCANS: dict[str, tuple[Callable, Callable, Callable, Callable]] = {
    "sum": (F.sum, F.sum, F.sum, lambda carry, x: F.when(carry.isNull(), x).when(x.isNull(), carry).otherwise(carry + x)),
    "count": (F.count, F.count, F.sum, lambda carry, x: F.coalesce(carry, F.lit(0)) + x),
    "min": (F.min, F.min, F.min, lambda carry, x: F.least(carry, x)),
    "max": (F.max, F.max, F.max, lambda carry, x: F.greatest(carry, x)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(ROW))), lambda c: F.last(c, ignorenulls=True), lambda carry, x: F.coalesce(x, carry)),
}


def scan(df: DataFrame, measures: dict[str, tuple[str, str | Column]], order_by: list[str | Column], partition_by: list[str] = ()) -> DataFrame:
    """The rows with running aggregates {new: (kind, value)} from the pane's first row to this one, in order.

    kind: sum, count, min, max, or last, the last value that is not null. Nulls do not count; before the first value
    the result is null (0 for count). A new column replaces one of its name. An empty table gives an empty one.
    """
    keys = list(partition_by)
    order = [F.col(o[1:]).desc() if isinstance(o, str) and o.startswith("-") else F.col(o).asc() if isinstance(o, str) else o for o in order_by]
    values = {f"\0v{i}": F.col(v) if isinstance(v, str) else v for i, (_, v) in enumerate(measures.values())}
    parts = ordered_parts(df.withColumns(values), order, keys)
    here: WindowSpec = Window.partitionBy(PART, *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    kinds = {f"\0s{i}": (f"\0v{i}", _SCANS[kind]) for i, (kind, _) in enumerate(measures.values())}
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = _cut(parts, keys, {s: k[1](F.col(v)) for s, (v, k) in kinds.items()})
    carried = ends.select(PART, *keys, *[k[2](F.col(s)).over(before).alias("\0c" + s) for s, (_, k) in kinds.items()])
    joined = _with_carries(parts.withColumns({s: k[0](F.col(v)).over(here) for s, (v, k) in kinds.items()}), carried, keys)
    done = {new: k[3](F.col("\0c" + s), F.col(s)) for new, (s, (_, k)) in zip(measures, kinds.items(), strict=True)}
    return joined.withColumns(done).select(*df.columns, *[c for c in measures if c not in df.columns])


def _with_carries(parts: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Fewer than two carries a part: a broadcast bounded by the number of parts."""
    named = carried.withColumnsRenamed({c: "\0key_" + c for c in (PART, *keys)})
    same = F.col(PART) == F.col("\0key_" + PART)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("\0key_" + k))
    return parts.join(F.broadcast(named), same, "left").drop(*["\0key_" + c for c in (PART, *keys)])


def recursion(df: DataFrame, new: str, start: float, factor: Column, added: Column, order_by: list[Column], partition_by: list[str] = ()) -> DataFrame:
    """new = factor * (new in the previous row of the pane) + added, in order, from `start`: a scan of composed steps.

    Two steps in a row are one step of the same kind, so each part is folded to one step, the folds are
    composed along the parts, and each part is run again from the value that reaches it. A part streams through
    Arrow batches in order; what a task holds is one batch and one number. A null factor or addition makes this row and the pane's later ones null.
    """
    keys = list(partition_by)
    parts = ordered_parts(df.withColumn("\0a", factor.cast("double")).withColumn("\0b", added.cast("double")), order_by, keys)
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    typed = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def sorted_parts(columns: DataFrame) -> DataFrame:
        return columns.repartition(PART).sortWithinPartitions(PART, ROW)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The composed step of each pane's rows in each part."""
        at, step = None, (1.0, 0.0)
        for b in batches:
            out = []
            for head, a, c in zip(b["\0pane"], b["\0a"], b["\0b"], strict=True):
                if head != at:
                    if at is not None:
                        out.append((at, *step))
                    at, step = head, (1.0, 0.0)
                step = (a * step[0], a * step[1] + c)
            yield pd.DataFrame(out, columns=["\0pane", "\0a", "\0b"])
        if at is not None:
            yield pd.DataFrame([(at, *step)], columns=["\0pane", "\0a", "\0b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x = None, start
        for b in batches:
            out = []
            for head, first, a, c in zip(b["\0pane"], b["\0start"], b["\0a"], b["\0b"], strict=True):
                if head != at:
                    at, x = head, first
                x = a * x + c
                out.append(x)
            yield b[[PART, ROW]].assign(**{"\0x": out})

    # Panes of a part are told apart by the place of their first row in it.
    pane = F.min(ROW).over(Window.partitionBy(PART, *keys)).alias("\0at") if keys else F.lit(0).cast("long")
    steps = settled(parts.select(PART, ROW, *keys, F.coalesce("\0a", F.lit(float("nan"))).alias("\0a"), F.coalesce("\0b", F.lit(float("nan"))).alias("\0b"), pane.alias("\0at"))).withColumn("\0pane", F.concat_ws(":", PART, "\0at"))
    folded = sorted_parts(steps.select(PART, ROW, "\0pane", "\0a", "\0b")).mapInPandas(fold, "`\0pane` string, `\0a` double, `\0b` double")
    heads = steps.filter(F.col(ROW) == F.col("\0at")) if keys else steps.filter(f"`{ROW}` = 0")
    each = heads.select(PART, *keys, F.col("\0pane").alias("\0p")).join(folded, F.col("\0p") == F.col("\0pane"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # A pane has one step a part: composing them is a fold over at most as many as there are parts.
    wide = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("\0n")).filter("`\0n` > 1")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("\0key_" + k))
    cut = each.join(wide.withColumnsRenamed({k: "\0key_" + k for k in keys}), same)
    earlier = F.collect_list(F.struct(F.col(PART).alias("p"), F.col("\0a").alias("a"), F.col("\0b").alias("b"))).over(before)
    nan = F.lit(float("nan"))  # what pandas gives back as null
    reached = F.aggregate(earlier, F.lit(float(start)), lambda x, s: F.coalesce(s["a"], nan) * x + F.coalesce(s["b"], nan))
    begun = cut.select(F.col("\0pane").alias("\0q"), reached.alias("\0from"))
    with_start = steps.select(PART, ROW, "\0pane", "\0a", "\0b").join(F.broadcast(begun), F.col("\0pane") == F.col("\0q"), "left").withColumn("\0start", F.coalesce("\0from", F.lit(float(start))))
    values = sorted_parts(with_start.select(PART, ROW, "\0pane", "\0start", "\0a", "\0b")).mapInPandas(run, f"{typed([PART, ROW])}, `\0x` double")
    return parts.join(values, [PART, ROW]).withColumn(new, F.nanvl("\0x", F.lit(None).cast("double"))).select(*df.columns, *[c for c in (new,) if c not in df.columns])
