"""Value cleaning steps. Each returns a function for DataFrame.transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .columns import Step, aliases


def _each(names: tuple[str, ...], change: Callable[[Column], Column]) -> Step:
    return lambda df: df.withColumns({c: change(F.col(c)) for c in names})


def replace_value(name: str, old: object, new: object, within: bool = False) -> Step:
    """The whole value, or with `within` every occurrence in a text."""
    changed = F.replace(F.col(name), F.lit(old), F.lit(new)) if within else F.when(F.col(name) == F.lit(old), F.lit(new)).otherwise(F.col(name))
    return lambda df: df.withColumn(name, changed)


def replace_nulls(values: dict[str, object]) -> Step:
    return lambda df: df.fillna(values)


def trim(*names: str) -> Step:
    return _each(names, F.trim)


def clean(*names: str) -> Step:
    """Without control characters."""
    return _each(names, lambda c: F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""))


def upper(*names: str) -> Step:
    return _each(names, F.upper)


def lower(*names: str) -> Step:
    return _each(names, F.lower)


def proper(*names: str) -> Step:
    return _each(names, F.initcap)


def remove_kind(kind: str, *names: str) -> Step:
    """Without letters, numbers or punctuation."""
    pattern = {"letters": r"\p{L}", "numbers": r"\p{N}", "punctuation": r"\p{Punct}"}[kind]
    return _each(names, lambda c: F.regexp_replace(c, pattern, ""))


def fill_down(names: list[str], order_by: list[str], partition_by: list[str] = ()) -> Step:
    """The last value before a null, in order within the partition; without one, over the whole table by ranges of its order."""
    return _filled(names, [F.col(o).asc() for o in order_by], partition_by)


def fill_up(names: list[str], order_by: list[str], partition_by: list[str] = ()) -> Step:
    """The first value after a null: filled down in backward order, so that no frame shrinks."""
    return _filled(names, [F.col(o).desc() for o in order_by], partition_by)


def _filled(names: list[str], order: list[Column], partition_by: list[str]) -> Step:
    if not partition_by:
        return lambda df: scans.scan(df, {c: ("last", c) for c in names}, order)
    w = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lambda df: df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})


def group_replace(name: str, clusters: dict[str, list[str]]) -> Step:
    """Each spelling by the value its cluster stands for."""
    return aliases(name, {v: good for good, spellings in clusters.items() for v in spellings})


def extract_values(name: str, pattern: str, new: str, group: int = 0) -> Step:
    return lambda df: df.withColumn(new, F.nullif(F.regexp_extract(name, pattern, group), F.lit("")))


def text_before(x: Column, delimiter: str) -> Column:
    """Up to the first delimiter; the whole text without one."""
    return F.substring_index(x, delimiter, 1)


def text_after(x: Column, delimiter: str) -> Column:
    """From the first delimiter on; empty without one."""
    at = F.locate(delimiter, x)
    return F.when(at > 0, F.substring(x, at + len(delimiter), F.length(x))).otherwise("")


def text_between(x: Column, start: str, end: str) -> Column:
    return F.substring_index(text_after(x, start), end, 1)


def pad_start(x: Column, n: int, fill: str = " ") -> Column:
    """At least n characters; longer texts stay whole."""
    return F.lpad(x, F.greatest(F.length(x), F.lit(n)), fill)


def pad_end(x: Column, n: int, fill: str = " ") -> Column:
    return F.rpad(x, F.greatest(F.length(x), F.lit(n)), fill)


def failed(name: str, kind: str) -> Column:
    """Whether a value is there but does not fit the type."""
    return F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()


def remove_errors(types: dict[str, str]) -> Step:
    """Only rows whose values all fit their types, cast."""

    def run(df: DataFrame) -> DataFrame:
        for c, t in types.items():
            df = df.filter(~failed(c, t))
        return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})

    return run


def replace_errors(types: dict[str, str], value: object) -> Step:
    return lambda df: df.withColumns({c: F.when(failed(c, t), F.lit(value).cast(t)).otherwise(F.col(c).try_cast(t)) for c, t in types.items()})


def try_otherwise(value: Column, fallback: Column) -> Column:
    return F.coalesce(value, fallback)


def parse_json(name: str, schema: str, new: str) -> Step:
    """A JSON text as a struct; what does not parse has null fields."""
    return lambda df: df.withColumn(new, F.from_json(name, schema))


def parse_xml(name: str, schema: str, new: str) -> Step:
    return lambda df: df.withColumn(new, F.from_xml(F.col(name), schema))


def regex_match(name: str, pattern: str, new: str) -> Step:
    return lambda df: df.withColumn(new, F.col(name).rlike(pattern))


def regex_extract(name: str, pattern: str, new: str, group: int = 1) -> Step:
    return lambda df: df.withColumn(new, F.nullif(F.regexp_extract(name, pattern, group), F.lit("")))


def regex_replace(name: str, pattern: str, by: str) -> Step:
    return _each((name,), lambda c: F.regexp_replace(c, pattern, by))


def remove_blank_rows() -> Step:
    return lambda df: df.dropna("all")
