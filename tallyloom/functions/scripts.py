"""User functions in Python: on Arrow batches, never row by row, and always callables, never source text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Results of scripts by name.
RESULTS = {"real": "double", "int": "bigint", "bool": "boolean", "str": "string"}


def script(kind: str, fn: Callable[..., pd.Series], *columns: Column) -> Column:
    """A function of whole series, as a column."""
    return F.pandas_udf(fn, RESULTS[kind])(*columns)


def table_step(fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None, together: bool = False):
    """A function of frames: batch by batch, or group by group, each group whole, with its keys and an index of its own.
    `together` gives it many whole groups at once, which it keeps apart itself (p.groupby(..., dropna=False)): its own cost
    then comes once a batch and not once a group.

    Groups come sorted and many to an Arrow batch, as a batch for each costs more than most functions of a small group. A
    group's integers and booleans are of those types if it has no nulls in them, whatever its neighbours hold.
    """
    if by:
        return lambda df: _grouped(df, fn, schema, by, together)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return lambda df: df.mapInPandas(run, schema)


def _grouped(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str], together: bool) -> DataFrame:
    """fn of each group. Nulls of integers and booleans travel beside the values, since a null turns a batch's column to floats or objects."""
    names = T._parse_datatype_string(schema).fieldNames()
    given = df.columns
    holes = {f.name: f"\0null {i}" for i, f in enumerate(df.schema) if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in holes else F.col(f"`{c}`") for c in given]
    keys = [F.col(f"`{k}`") for k in by]
    first = (F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1).alias("\0first")
    laid = df.select("*", first).select(*filled, *[F.isnull(f"`{c}`").alias(n) for c, n in holes.items()], "\0first")

    def with_nulls(p: pd.DataFrame, nulls: pd.DataFrame) -> pd.DataFrame:
        return p.assign(**{c: p[c].astype(object if p[c].dtype == bool else "float64").mask(nulls[n], None) for c, n in holes.items() if nulls[n].any()})

    def result(p: pd.DataFrame) -> pd.DataFrame:
        p.index = pd.RangeIndex(len(p))
        out = fn(p)
        if len(out) and list(out.columns) != names:
            if len(out.columns) != len(names):
                raise ValueError(f"columns {list(out.columns)} instead of {names}")
            out = out[names] if all(isinstance(c, str) for c in out.columns) else out.set_axis(names, axis=1)
        return out

    def groups(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Results of a frame of whole groups, those of equal types together."""
        values, nulls, starts = p[given], p[[*holes.values()]], np.flatnonzero(p["\0first"].to_numpy())
        if together:
            yield result(with_nulls(values, nulls))
            return
        gaps = np.logical_or.reduceat(nulls.to_numpy(bool).any(axis=1), starts)
        made, kinds = [], None
        for lo, hi, gap in zip(starts.tolist(), [*starts[1:].tolist(), len(p)], gaps.tolist(), strict=True):
            one = values.iloc[lo:hi].copy()
            out = result(with_nulls(one, nulls.iloc[lo:hi]) if gap else one)
            if len(out):
                if made and list(out.dtypes) != kinds:
                    yield pd.concat(made, ignore_index=True)
                    made = []
                made.append(out)
                kinds = list(out.dtypes)
        if made:
            yield pd.concat(made, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the open group's rows
        for b in batches:
            starts = np.flatnonzero(b["\0first"].to_numpy())
            if len(starts):
                done = [*held, b.iloc[: starts[-1]]]
                held = []
                if sum(map(len, done)):
                    yield from groups(pd.concat(done, ignore_index=True))
                b = b.iloc[starts[-1] :]
            held.append(b)
        if held:
            yield from groups(pd.concat(held, ignore_index=True))

    return laid.mapInPandas(run, schema)


def predict(model, df: DataFrame) -> DataFrame:
    """A fitted model of pyspark.ml."""
    return model.transform(df)


def aggregate(fn: Callable[[pd.Series], float], kind: str = "real"):
    """A function of a group's series that gives one value."""

    @F.pandas_udf(RESULTS[kind])
    def run(x: pd.Series) -> float:
        return fn(x)

    return run
