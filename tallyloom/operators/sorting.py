"""Order, limits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import Step, index


def _key(k: str | Column) -> Column:
    return k if isinstance(k, Column) else F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc()


def sort(*keys: str | Column) -> Step:
    """By several keys, descending with a leading minus."""
    return lambda df: df.orderBy(*map(_key, keys))


def sort_by_measure(name: str, measure: Column, descending: bool = True) -> Step:
    """Members of a field by an aggregate of their rows."""
    return lambda df: df.groupBy(name).agg(measure.alias("sort_key")).orderBy(F.desc("sort_key") if descending else F.asc("sort_key"), name)


def manual_rank(name: str, members: list) -> Column:
    """Place in a list written by hand; what is not listed comes last."""
    place = F.array_position(F.array(*[F.lit(m) for m in members]), F.col(name))
    return F.when(place > 0, place).otherwise(len(members) + 1)


def top(n: int, *keys: str | Column) -> Step:
    return lambda df: df.orderBy(*map(_key, keys)).limit(n)


def bottom(n: int, *keys: str) -> Step:
    """The last n in the given order."""
    turned = [k[1:] if k.startswith("-") else "-" + k for k in keys]
    return top(n, *turned)


def top_per_group(n: int, group: list[str], *keys: str | Column) -> Step:
    """The first n of each group; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*group).orderBy(*map(_key, keys))
    return lambda df: df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def skip(n: int, *keys: str | Column) -> Step:
    """All rows but the first n: the n-th row's number is found without gathering the rest in one task."""

    def run(df: DataFrame) -> DataFrame:
        return df.transform(index("\0i", [_key(k) for k in keys])).filter(F.col("\0i") > n).drop("\0i")

    return run


def remove_last(n: int, *keys: str) -> Step:
    turned = [k[1:] if k.startswith("-") else "-" + k for k in keys]
    return skip(n, *turned)


def sample(fraction: float, key: str, seed: int = 0) -> Step:
    """About this share of the rows, the same ones each time and in any engine, by the first 32 bits of the key's MD5."""
    digits = lambda: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    return lambda df: df.filter(F.conv(digits(), 16, 10).cast("long") % 1_000_000 < int(fraction * 1_000_000))


def sort_by_column(name: str, by: str) -> Step:
    """Different values of one column in the order of another, as month names by month numbers."""
    return lambda df: df.groupBy(name).agg(F.min(by).alias("sort_key")).orderBy("sort_key", name)
