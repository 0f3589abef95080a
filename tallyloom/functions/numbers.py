"""Number and point calculations, Column -> Column. What is undefined (a root of -1, division by 0) is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def absolute(x: Column) -> Column:
    return F.abs(x)


def ceiling(x: Column) -> Column:
    return F.ceil(x)


def floor(x: Column) -> Column:
    return F.floor(x)


def rounded(x: Column, digits: int = 0) -> Column:
    """Halves away from zero."""
    return F.round(x, digits)


def power(x: Column, y: Column | float) -> Column:
    return F.pow(x, y)


def square_root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def square(x: Column) -> Column:
    return x * x


def log(x: Column, base: float = 10.0) -> Column:
    """Null unless x > 0."""
    return F.when(x > 0, F.log10(x) if base == 10 else F.log(float(base), x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def exp(x: Column) -> Column:
    return F.exp(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def pi() -> Column:
    return F.pi()


def sin(x: Column) -> Column:
    return F.sin(x)


def cos(x: Column) -> Column:
    return F.cos(x)


def tan(x: Column) -> Column:
    return F.tan(x)


def acos(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.acos(x))


def asin(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.asin(x))


def atan(x: Column) -> Column:
    return F.atan(x)


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def cot(x: Column) -> Column:
    return F.when(F.sin(x) != 0, F.cos(x) / F.sin(x))


def radians(x: Column) -> Column:
    return F.radians(x)


def degrees(x: Column) -> Column:
    return F.degrees(x)


def div(a: Column, b: Column) -> Column:
    """Integer quotient, cut towards zero."""
    return F.when(b != 0, F.try_divide(a.cast("double"), b.cast("double")).cast("bigint"))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return F.when(b != 0, a - b * F.floor(a / b))


def _hex(x: Column, y: Column) -> tuple[Column, Column]:
    """Nearest centre of a grid of hexagons with width 1 and rows sqrt(3)/2 apart, every other row shifted by half."""
    height = 3**0.5
    ax, ay = F.round(x), F.round(y / height) * height
    bx, by = F.round(x - 0.5) + 0.5, (F.round(y / height - 0.5) + 0.5) * height
    first = (x - ax) ** 2 + (y - ay) ** 2 <= (x - bx) ** 2 + (y - by) ** 2
    return F.when(first, ax).otherwise(bx), F.when(first, ay).otherwise(by)


def hexbin_x(x: Column, y: Column) -> Column:
    return _hex(x, y)[0]


def hexbin_y(x: Column, y: Column) -> Column:
    return _hex(x, y)[1]


def make_point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def make_line(start: Column, end: Column) -> Column:
    return F.array(start, end)


def distance_km(a: Column, b: Column) -> Column:
    """Great-circle distance of two points."""
    lat1, lat2 = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.sin((lat2 - lat1) / 2) ** 2 + F.cos(lat1) * F.cos(lat2) * F.sin(F.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
