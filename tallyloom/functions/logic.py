"""Conditions, nulls and types, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def if_else(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """The first branch whose condition holds; null if none does and nothing else is given."""
    out = F
    for condition, value in branches:
        out = out.when(condition, _col(value))
    return out.otherwise(_col(otherwise))


def case(on: Column, values: dict, otherwise: object = None) -> Column:
    return if_else(*[(on == _col(k), v) for k, v in values.items()], otherwise=otherwise)


def iif(test: Column, yes: object, no: object, unknown: object = None) -> Column:
    """`unknown` where the test is null."""
    return F.when(test, _col(yes)).when(~test, _col(no)).otherwise(_col(unknown))


def is_null(x: Column) -> Column:
    return x.isNull()


def if_null(x: Column, other: object) -> Column:
    return F.coalesce(x, _col(other))


def zn(x: Column) -> Column:
    """Null as zero."""
    return F.coalesce(x, F.lit(0))


def is_number(s: Column) -> Column:
    return s.try_cast("double").isNotNull()


def not_(x: Column) -> Column:
    return ~x


def and_(*x: Column) -> Column:
    out = x[0]
    for y in x[1:]:
        out = out & y
    return out


def or_(*x: Column) -> Column:
    out = x[0]
    for y in x[1:]:
        out = out | y
    return out


#: Comparisons by sign.
COMPARE = {"=": Column.__eq__, "==": Column.__eq__, "!=": Column.__ne__, "<>": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}


def compare(a: Column, sign: str, b: object) -> Column:
    return COMPARE[sign](a, _col(b))


def to_int(x: Column) -> Column:
    """Cut towards zero."""
    return x.try_cast("double").cast("bigint")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_str(x: Column) -> Column:
    return x.cast("string")


def to_date(x: Column, pattern: str | None = None) -> Column:
    return F.try_to_date(x, pattern) if pattern else F.try_to_date(x)


def to_datetime(x: Column) -> Column:
    return F.try_to_timestamp(x)


def user_name(user: str | None = None) -> Column:
    return F.lit(user) if user is not None else F.current_user()


def parameter(params: dict, name: str) -> Column:
    """A parameter's current value."""
    return F.lit(params[name])
