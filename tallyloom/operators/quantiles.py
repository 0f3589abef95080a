"""Exact quantiles of groups of any size by distributed selection: sketches bound where a rank can lie, counts prove it,
and only the few values between the bounds are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.shared import settled

#: Points of a sketch, its accuracy (a rank error of n / ACCURACY, far below the gap of two points), values that one sort may get,
#: and rows of bounds that may be broadcast.
GRID, ACCURACY, SORTED, BROADCAST_ROWS = 128, 2_000, 100_000, 20_000


def _beside(rows: DataFrame, bounds: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Each row with its group's bounds: broadcast if their count is small, else joined by key, where AQE splits hot groups."""
    named = bounds.withColumnsRenamed({k: "\0key_" + k for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("\0key_" + k)) for k in keys], F.lit(True))
    return rows.join(F.broadcast(named) if few else named, same).drop(*["\0key_" + k for k in keys])


def _low(grid: Column, k: Column, m: Column) -> Column:
    """A point of a sketch of m sorted values that is at most the value of rank k, from 0."""
    return F.element_at(grid, F.greatest(F.floor((k - 1 - m / ACCURACY) / m * GRID).cast("int"), F.lit(0)) + 1)


def _high(grid: Column, k: Column, m: Column) -> Column:
    """One that is at least that value."""
    return F.element_at(grid, F.least(F.ceil((k + 2 + m / ACCURACY) / m * GRID).cast("int"), F.lit(GRID)) + 1)


def quantiles(df: DataFrame, value: str | Column, wanted: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """(keys, one column for each name in `wanted`): inclusive, interpolated quantiles of doubles, nulls left out.

    A group of only nulls has null quantiles; without keys there is one row, of nulls for an empty table. Each round
    sketches the values between a target's bounds, which gives closer ones, until at most SORTED different values can be
    left between them. One last pass counts what lies below, between and inside all bounds; a running sum over those
    counts, which are in order, meets each rank. No task holds a group's values, and repeated values are counts. A rank
    that the counts do not find between its bounds would raise an error, not give a wrong value.
    """
    keys = list(keys)
    given = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("\0x"))
    rows, x, n = given.filter(F.col("\0x").isNotNull()), F.col("\0x"), F.col("\0n")
    sketch = lambda v: F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], ACCURACY)
    # Of the two ranks, from 0, that a quantile lies between, the lower one; the other is the next, if there is one.
    ranks = [F.floor(F.lit(p) * (n - 1)).cast("long") for p in wanted.values()]
    lows, highs = [f"\0lo{i}" for i in range(len(ranks))], [f"\0hi{i}" for i in range(len(ranks))]

    first = rows.groupBy(*keys).agg(F.count(x).alias("\0n"), sketch(x).alias("\0grid"))
    around = [(_low(F.col("\0grid"), k, n), _high(F.col("\0grid"), k + 1, n)) for k in ranks]
    state = settled(first.select(*keys, "\0n", *[a.alias(c) for (a, _), c in zip(around, lows, strict=True)], *[b.alias(c) for (_, b), c in zip(around, highs, strict=True)]))
    seen = state.agg(F.count(F.lit(1)).alias("groups"), F.max("\0n").alias("most")).first()
    few, left = seen.groups <= BROADCAST_ROWS, (seen.most or 0) * 5 // GRID
    while left > SORTED:
        told = _beside(rows, state, keys, few).groupBy(*keys).agg(
            *[F.first(c).alias(c) for c in ("\0n", *lows, *highs)],
            *[F.count_if(x <= F.col(lo)).alias("\0below" + lo) for lo in lows],
            *[F.count_if((x > F.col(lo)) & (x < F.col(hi))).alias("\0in" + lo) for lo, hi in zip(lows, highs, strict=True)],
            *[sketch(F.when((x > F.col(lo)) & (x < F.col(hi)), x)).alias("\0grid" + lo) for lo, hi in zip(lows, highs, strict=True)],
        )
        moved = []
        for k, lo, hi in zip(ranks, lows, highs, strict=True):
            below, m, grid = F.col("\0below" + lo), F.col("\0in" + lo), F.col("\0grid" + lo)
            a, b = _low(grid, F.greatest(k - below, F.lit(0)), m), _high(grid, F.least(k + 1 - below, m - 1), m)
            # Ranks before and after the values inside are copies of the bounds themselves.
            moved.append(F.when(k >= below + m, F.col(hi)).when((k < below) | (m == 0), F.col(lo)).otherwise(a).alias(lo))
            moved.append(F.when(k + 1 < below, F.col(lo)).when((k + 1 >= below + m) | (m == 0), F.col(hi)).otherwise(b).alias(hi))
        told = settled(told.select(*keys, "\0n", F.greatest(*["\0in" + lo for lo in lows], F.lit(0)).alias("\0most"), *moved))
        left = (told.agg(F.max("\0most")).first()[0] or 0) * 5 // GRID
        state = told.drop("\0most")

    # Cells between the bounds, in order; outside all bounds only the cell is counted, and comes before its bound's copies.
    edges = [*lows, *highs]
    cell = reduce(lambda a, b: a + b, [(x > F.col(e)).cast("int") for e in edges])
    kept = reduce(lambda a, b: a | b, [x.between(F.col(lo), F.col(hi)) for lo, hi in zip(lows, highs, strict=True)])
    counted = _beside(rows, state, keys, few).groupBy(*keys, "\0n", cell.alias("\0cell"), F.when(kept, x).alias("\0v")).agg(F.count(F.lit(1)).alias("\0c"))
    upto = F.sum("\0c").over(Window.partitionBy(*keys).orderBy("\0cell", F.col("\0v").asc_nulls_first()))
    placed = counted.withColumn("\0upto", upto)
    at = lambda k: F.max(F.when((F.col("\0upto") > k) & (F.col("\0upto") - F.col("\0c") <= k), F.coalesce("\0v", F.raise_error(F.lit("a rank lies outside its bounds")).cast("double"))))
    found = placed.groupBy(*keys, "\0n").agg(*[v.alias(c) for k, lo, hi in zip(ranks, lows, highs, strict=True) for v, c in ((at(k), lo), (at(F.least(k + 1, n - 1)), hi))])
    part = [F.lit(p) * (n - 1) - k for p, k in zip(wanted.values(), ranks, strict=True)]
    out = found.select(*keys, *[F.when(F.col(lo) == F.col(hi), F.col(lo)).otherwise((1 - f) * F.col(lo) + f * F.col(hi)).alias(name) for name, f, lo, hi in zip(wanted, part, lows, highs, strict=True)])
    # Groups without a value, and the one group of no keys.
    groups = given.groupBy(*keys).agg(F.count(x).alias("\0n")).filter("`\0n` = 0").drop("\0n") if keys else None
    if keys:
        return out.unionByName(groups, allowMissingColumns=True)
    return out if seen.groups and seen.most else df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(name) for name in wanted])
