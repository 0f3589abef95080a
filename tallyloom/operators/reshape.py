"""Unions, pivots, headers and nested values."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import Step

#: Types from narrow to wide.
WIDTH = ["boolean", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "string"]


def union(*frames: DataFrame) -> DataFrame:
    """By name; a column that a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_named(frames: dict[str, DataFrame], column: str = "Table Names") -> DataFrame:
    return union(*[df.withColumn(column, F.lit(n)) for n, df in frames.items()])


def _wider(a: str, b: str) -> str:
    kind = lambda t: "decimal" if t.startswith("decimal") else "timestamp" if t.startswith("timestamp") else t
    x, y = kind(a), kind(b)
    if x == y:
        return a
    if "string" not in (x, y) and (x in ("date", "timestamp")) != (y in ("date", "timestamp")):
        raise TypeError(f"a date and a number do not union: {a}, {b}")
    if "string" in (x, y):
        warnings.warn(f"values of types {a} and {b} become text", stacklevel=3)
    return a if WIDTH.index(x) > WIDTH.index(y) else b


def union_widened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of different types take the wider one; a date with a number is refused, text with a number warned of."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    wide = {c: _wider(left[c], right[c]) for c in left if c in right and left[c] != right[c]}

    def cast(df: DataFrame) -> DataFrame:
        number = {c: F.col(c).cast("int") if dict(df.dtypes)[c] == "boolean" and t != "string" else F.col(c) for c, t in wide.items()}
        return df.withColumns({c: number[c].cast(t) for c, t in wide.items()})

    return union(cast(a), cast(b))


def unpivot(ids: list[str], columns: list[str] | None, name: str = "Attribute", value: str = "Value", keep_nulls: bool = False) -> Step:
    """Listed columns (or all others) to rows; null values are dropped unless kept."""

    def run(df: DataFrame) -> DataFrame:
        out = df.unpivot(ids, columns, name, value)
        return out if keep_nulls else out.filter(F.col(value).isNotNull())

    return run


def pivot(ids: list[str], key: str, value: Column, values: list | None = None) -> Step:
    """Rows to columns; give `values` to save the job that looks for them."""
    return lambda df: df.groupBy(*ids).pivot(key, values).agg(value)


def transpose(index: str, rows: int = 1000) -> Step:
    """Columns to rows, for a small table: more than `rows` rows are an error."""

    def run(df: DataFrame) -> DataFrame:
        if df.limit(rows + 1).count() > rows:
            raise ValueError(f"more than {rows} rows would become columns")
        return df.transpose(F.col(index))

    return run


def promote_headers(order_by: str) -> Step:
    """The first row's values as names."""

    def run(df: DataFrame) -> DataFrame:
        first = df.orderBy(order_by).first()
        names = {c: str(first[c]) for c in df.columns if c != order_by}
        return df.filter(F.col(order_by) != first[order_by]).select(*[F.col(c).alias(n) for c, n in names.items()])

    return run


def demote_headers() -> Step:
    """The names as a row of their own; all values become text, columns are Column1, Column2, ..."""

    def run(df: DataFrame) -> DataFrame:
        names = [f"Column{i + 1}" for i in range(len(df.columns))]
        head = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"`{n}` string" for n in names))
        return head.union(df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(df.columns, names, strict=True)]))

    return run


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Each key of either side once, as added, removed or shared."""
    x, y = a.select(*keys).distinct().withColumn("\0a", F.lit(True)), b.select(*keys).distinct().withColumn("\0b", F.lit(True))
    status = F.when(F.col("\0a").isNull(), "added").when(F.col("\0b").isNull(), "removed").otherwise("shared")
    return x.join(y, keys, "full").select(*keys, status.alias("status"))


def list_contains(name: str, members: list) -> Column:
    return F.array_contains(F.array(*[F.lit(m) for m in members]), F.col(name))


def expand_record(name: str, prefix: str = "") -> Step:
    """The fields of a struct as columns."""
    return lambda df: df.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{f}").alias(prefix + f) for f in df.schema[name].dataType.names])


def expand_list(name: str) -> Step:
    """A row for each element; an empty or null list keeps its row with null."""
    return lambda df: df.withColumn(name, F.explode_outer(name))


def to_json_text(x: Column) -> Column:
    return F.to_json(x)
