"""Column shaping steps. Each returns a function for DataFrame.transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[DataFrame], DataFrame]
#: Mappings with more entries than this become lookup tables.
LARGE_MAP = 100


def rename(names: dict[str, str]) -> Step:
    return lambda df: df.withColumnsRenamed(names)


def remove(*names: str) -> Step:
    return lambda df: df.drop(*names)


def keep(*names: str) -> Step:
    return lambda df: df.select(*names)


def duplicate(name: str, new: str) -> Step:
    return lambda df: df.withColumn(new, F.col(name))


def reorder(*first: str) -> Step:
    return lambda df: df.select(*first, *[c for c in df.columns if c not in first])


def change_type(types: dict[str, str]) -> Step:
    """Values that do not fit become null."""
    return lambda df: df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def add_column(name: str, value: Column) -> Step:
    return lambda df: df.withColumn(name, value)


def conditional(name: str, rules: list[tuple[Column, object]], default: object = None) -> Step:
    """The value of the first rule that holds."""
    value = F
    for condition, then in rules:
        value = value.when(condition, then)
    return lambda df: df.withColumn(name, value.otherwise(default))


def split_by(name: str, delimiter: str, parts: int | None = None) -> Step:
    """name_1 ... name_n; without `parts`, one pass finds the most parts of any value."""

    def step(df: DataFrame) -> DataFrame:
        cut = F.split(F.col(name), F.lit("\\Q" + delimiter + "\\E"))
        n = parts if parts is not None else df.agg(F.max(F.size(cut))).first()[0] or 0
        return df.withColumns({f"{name}_{i + 1}": F.get(cut, F.lit(i)) for i in range(n)})

    return step


def split_at(name: str, positions: list[int]) -> Step:
    """name_1 ... name_n, each from one position (0 is the first) to the next."""
    ends = [*positions[1:], None]
    cut = lambda a, b: F.substring(F.col(name), F.lit(a + 1), F.lit(b - a) if b is not None else F.length(name))
    return lambda df: df.withColumns({f"{name}_{i + 1}": cut(a, b) for i, (a, b) in enumerate(zip(positions, ends, strict=True))})


def merge(names: list[str], new: str, separator: str = " ") -> Step:
    """Join columns as text, nulls left out; the sources go."""
    return lambda df: df.withColumn("\0merged", F.concat_ws(separator, *[F.col(c).cast("string") for c in names])).drop(*names).withColumnRenamed("\0merged", new)


def combined(names: list[str], new: str, separator: str = ", ") -> Step:
    """As merge(), but the sources stay."""
    return lambda df: df.withColumn(new, F.concat_ws(separator, *[F.col(c).cast("string") for c in names]))


def index(new: str, order_by: list[str], start: int = 1, step: int = 1) -> Step:
    """Number the rows in order, over many tasks: sort by range, number within partitions, add the sizes before.

    The rows with their places are written once to the session's shared folder, so that sizes and numbers come from
    the same partitions whatever Spark recomputes. The partition sizes, one number for each, are all that the driver
    or a broadcast sees.
    """
    from tallyloom.shared import settled

    def run(df: DataFrame) -> DataFrame:
        ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        marked = settled(ranged.withColumn("\0part", F.spark_partition_id()).withColumn("\0row", F.monotonically_increasing_id()))
        within = F.col("\0row") - F.col("\0part").cast("long") * (1 << 33)
        sizes = marked.groupBy("\0part").agg(F.max(within).alias("\0last"))
        before = Window.orderBy("\0part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("\0before", F.coalesce(F.sum(F.col("\0last") + 1).over(before), F.lit(0))).drop("\0last")
        return marked.join(F.broadcast(starts), "\0part").withColumn(new, (within + F.col("\0before")) * step + start).drop("\0part", "\0row", "\0before")

    return run


def aliases(name: str, values: dict) -> Step:
    """Show other values for some; a long list is joined as a table."""

    def run(df: DataFrame) -> DataFrame:
        if len(values) <= LARGE_MAP:
            pairs = [F.lit(x) for kv in values.items() for x in kv]
            return df.withColumn(name, F.coalesce(F.create_map(*pairs)[F.col(name)], F.col(name)) if pairs else F.col(name))
        return _looked_up(df, name, name, values, F.col(name))

    return run


def _looked_up(df: DataFrame, name: str, new: str, values: dict, otherwise: Column) -> DataFrame:
    kind = df.schema[name].dataType
    table = df.sparkSession.createDataFrame(list(values.items()), T.StructType([T.StructField("\0key", kind), T.StructField("\0value", T.StringType())]))
    joined = df.join(F.broadcast(table), F.col(name) == F.col("\0key"), "left")  # as long as the mapping the caller wrote down
    return joined.withColumn(new, F.coalesce("\0value", otherwise)).drop("\0key", "\0value")


def set_column(new: str, name: str | None = None, members: list | None = None, condition: Column | None = None) -> Step:
    """IN or OUT, by a list of members or a condition; null counts as OUT."""
    inside = F.col(name).isin(members) if condition is None else condition
    return lambda df: df.withColumn(new, F.when(inside, "IN").otherwise("OUT"))


def group_column(new: str, name: str, groups: dict[str, list], other: str = "Other") -> Step:
    """The label of the group that holds the value; long groups are joined as a table."""

    def run(df: DataFrame) -> DataFrame:
        if sum(map(len, groups.values())) > LARGE_MAP:
            return _looked_up(df, name, new, {v: g for g, vs in groups.items() for v in vs}, F.lit(other))
        value = F
        for label, members in groups.items():
            value = value.when(F.col(name).isin(members), label)
        return df.withColumn(new, value.otherwise(other))

    return run


def combined_group(new: str, *parts: Column | str) -> Step:
    """Several fields, or parts of dates, joined by a bar."""
    return lambda df: df.withColumn(new, F.concat_ws(" | ", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def bin_column(new: str, name: str, size: float) -> Step:
    return lambda df: df.withColumn(new, F.floor(F.col(name) / size) * size)


#: Derivation prefixes: parts as numbers, and t-forms cut to a date.
PARTS = {"yr": "year", "qr": "quarter", "mn": "month", "wk": "week", "dy": "day", "hr": "hour", "mt": "minute", "sc": "second"}


def derive(new: str, name: str, prefix: str) -> Step:
    """A date part (yr, qr, mn, ...) or a date cut to it (tyr, tqr, ...)."""
    from tallyloom.functions import dates

    value = dates.trunc(PARTS[prefix[1:]], F.col(name)) if prefix[0] == "t" and prefix[1:] in PARTS else dates.part(PARTS[prefix], F.col(name))
    return lambda df: df.withColumn(new, value)


def formatted(x: Column, pattern: str) -> Column:
    """A number as text by a pattern such as #,##0.00, 0.0% or $#,##0."""
    digits = len(pattern.rstrip("%").partition(".")[2])
    scaled = x * 100 if pattern.endswith("%") else x
    text = F.format_number(scaled, digits) if "," in pattern else F.format_string(f"%.{digits}f", scaled.cast("double"))
    lead = pattern[0] if pattern[:1] in ("$", "€", "£") else ""
    return F.concat(F.lit(lead), text, F.lit("%" if pattern.endswith("%") else ""))


def magnitude(x: Column, digits: int = 1) -> Column:
    """1.2K, 3.4M, 5.6B."""
    size = F.abs(x)
    cut = lambda by, letter: F.concat(F.format_string(f"%.{digits}f", (x / by).cast("double")), F.lit(letter))
    return F.when(size >= 1e9, cut(1e9, "B")).when(size >= 1e6, cut(1e6, "M")).when(size >= 1e3, cut(1e3, "K")).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def coerce(declared: dict[str, str]) -> Step:
    """Cast the columns whose type is not the declared one; what does not fit is null."""

    def run(df: DataFrame) -> DataFrame:
        now = dict(df.dtypes)
        by = {"date": F.try_to_date, "timestamp": F.try_to_timestamp}
        changed = {c: by[t](F.col(c)) if t in by and now[c] == "string" else F.col(c).try_cast(t) for c, t in declared.items() if now.get(c, t) != t}
        return df.withColumns(changed) if changed else df

    return run
