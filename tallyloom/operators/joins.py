"""Joins over key pairs. Catalyst and AQE choose the physical join; nothing here forces a broadcast of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = list[tuple[str | Column, str | Column]]
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "leftOnly": "left_anti"}


def _pairs(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    side = lambda df, k: df[k] if isinstance(k, str) else k
    out = F.lit(True)
    for a, b in keys:
        out = out & (side(left, a) == side(right, b))
    return out


def join(left: DataFrame, right: DataFrame, keys: Keys, kind: str, expand: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Join on equal keys, one or several, columns or expressions.

    `expand` names the columns taken from the right side (all but its keys if not given); with `prefix` their
    names are prefixed. kind: inner, left, right, full, leftOnly, rightOnly or notInner, which keeps the rows
    of either side that match nothing.
    """
    if kind == "rightOnly":
        return right.join(left, _pairs(left, right, keys), "left_anti")
    if kind == "leftOnly":
        return left.join(right, _pairs(left, right, keys), "left_anti")
    right_keys = {b for _, b in keys if isinstance(b, str)}
    names = [c for c in right.columns if c not in right_keys] if expand is None else expand
    if kind in ("right", "full", "notInner"):
        names = names + [b for _, b in keys if isinstance(b, str) and b not in names and b not in left.columns]
    marked_l, marked_r = left.withColumn("\0l", F.lit(True)), right.withColumn("\0r", F.lit(True))
    joined = marked_l.join(marked_r, _pairs(marked_l, marked_r, keys), "full" if kind == "notInner" else KINDS[kind])
    if kind == "notInner":
        joined = joined.filter(F.col("\0l").isNull() | F.col("\0r").isNull())
    return joined.select(*[marked_l[c] for c in left.columns], *[marked_r[c].alias(prefix + c) for c in names])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row with every row: a feature of the prep flows, for small sides."""
    return left.crossJoin(right)


def buffered(right: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """A right side that is used again, written once to the shared folder; broadcast if its rows, measured as text, are that small."""
    from tallyloom.shared import settled

    kept = settled(right)
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long") + 16)).first()[0] or 0
    return F.broadcast(kept) if size <= broadcast_bytes else kept


def blend(primary: DataFrame, secondary: DataFrame, links: list[str], measures: dict[str, Column], kind: str = "left") -> DataFrame:
    """The secondary source, aggregated to the link fields, joined to the primary; without links, appended."""
    if not links:
        return primary.unionByName(secondary, allowMissingColumns=True)
    return primary.join(secondary.groupBy(*links).agg(*[m.alias(n) for n, m in measures.items()]), links, kind)


def related(many: DataFrame, one: DataFrame, keys: Keys, columns: list[str]) -> DataFrame:
    """Columns of the one-side for each row of the many-side."""
    return join(many, one, keys, "left", columns)


def lookup_value(left: DataFrame, right: DataFrame, key: tuple[str, str], column: str) -> DataFrame:
    """The one value that all matching rows share; null where they have several."""
    single = right.groupBy(F.col(key[1]).alias("\0k")).agg(F.min(column).alias("\0lo"), F.max(column).alias("\0hi"))
    out = left.join(single, F.col(key[0]) == F.col("\0k"), "left")
    return out.withColumn(column, F.when(F.col("\0lo") == F.col("\0hi"), F.col("\0lo"))).drop("\0k", "\0lo", "\0hi")


def star(fact: DataFrame, *dimensions: tuple[DataFrame, str | Column, str]) -> DataFrame:
    """Left joins of a fact to its dimensions, each by (dimension, fact key, dimension key)."""
    out = fact
    for dim, fk, dk in dimensions:
        out = out.join(dim, (F.col(fk) if isinstance(fk, str) else fk) == dim[dk], "left")
    return out


def snowflake(dimension: DataFrame, *parents: tuple[DataFrame, str, str, list[str]]) -> DataFrame:
    """A dimension with columns of its own dimensions, each by (parent, key, parent's key, columns): folded before the fact is
    met, so that the fact is shuffled for the dimension only."""
    for parent, fk, pk, columns in parents:
        named = parent.select(F.col(pk).alias("\0pk"), *columns)
        dimension = dimension.join(named, F.col(fk) == F.col("\0pk"), "left").drop("\0pk")
    return dimension


def star_totals(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str, list[str]]], sums: dict[str, Column]) -> DataFrame:
    """Sums by columns of dimensions, each dimension given as (rows, fact key, its unique key, columns).

    Dimensions are joined in the order given, the one with most rows first; between joins the rows are summed by the columns
    known and the keys still open, so every join and shuffle after the first sees sums, not rows. Facts without a
    dimension row have null columns.
    """
    values = {f"\0s{i}": s for i, s in enumerate(sums.values())}
    keys, done = [fk for _, fk, _, _ in dimensions], []
    out = fact.select(*dict.fromkeys(keys), *[v.alias(n) for n, v in values.items()])
    for i, (dim, fk, dk, columns) in enumerate(dimensions):
        if i:
            out = out.groupBy(*done, *dict.fromkeys(keys[i:])).agg(*[F.sum(n).alias(n) for n in values])
        named = dim.select(F.col(dk).alias("\0dk"), *columns)
        out, done = out.join(named, F.col(fk) == F.col("\0dk"), "left").drop("\0dk"), done + columns
    return out.groupBy(*done).agg(*[F.sum(n).alias(new) for new, n in zip(sums, values, strict=True)])


def cardinality(left: DataFrame, right: DataFrame, key: tuple[str, str]) -> DataFrame:
    """One row: how often keys repeat on either side, and the kind of the relationship."""
    most = lambda df, k, n: df.filter(F.col(k).isNotNull()).groupBy(k).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias(n))
    both = most(left, key[0], "left_most").crossJoin(most(right, key[1], "right_most"))  # one row each
    name = F.concat(F.when(F.col("left_most") > 1, "many").otherwise("one"), F.lit("-to-"), F.when(F.col("right_most") > 1, "many").otherwise("one"))
    return both.withColumn("kind", name)


def aligned(many: DataFrame, one: DataFrame, key: tuple[str, str]) -> DataFrame:
    """The one-side with its key cast to the many-side's type."""
    return one.withColumn(key[1], F.col(key[1]).try_cast(many.schema[key[0]].dataType))
