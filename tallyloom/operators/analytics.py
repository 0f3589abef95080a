"""Reference lines, bands, trends, forecasts and clusters."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lod import fixed
from .quantiles import quantiles


def reference_line(df: DataFrame, value: str, kind: str, pane: list[str] = (), p: float = 0.5, constant: float | None = None, new: str = "line") -> DataFrame:
    """A line beside each row: constant, average, median, percentile, min, max or mode of its pane or the table."""
    if kind == "constant":
        return df.withColumn(new, F.lit(constant))
    if kind in ("median", "percentile"):
        return _with_quantiles(df, value, {new: 0.5 if kind == "median" else p}, list(pane))
    made = {"average": F.avg, "min": F.min, "max": F.max, "mode": lambda x: F.mode(x, True)}[kind](value)
    return fixed(df, list(pane), {new: made})


def band(df: DataFrame, value: str, low: Column, high: Column) -> DataFrame:
    """Whether a value lies in a band."""
    return df.withColumn("in_band", F.col(value).between(low, high))


def deviation_band(df: DataFrame, value: str, pane: list[str] = (), low: float = -1, high: float = 1) -> DataFrame:
    """Mean plus low and high standard deviations."""
    return fixed(df, list(pane), {"band_low": F.avg(value) + low * F.stddev_samp(value), "band_high": F.avg(value) + high * F.stddev_samp(value)})


def percentile_band(df: DataFrame, value: str, pane: list[str] = (), low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Between two exact percentiles of the pane or the table."""
    return _with_quantiles(df, value, {"band_low": low, "band_high": high}, list(pane))


def _with_quantiles(df: DataFrame, value: str, wanted: dict[str, float], pane: list[str]) -> DataFrame:
    found = quantiles(df, value, wanted, pane).withColumnsRenamed({k: "\0key_" + k for k in pane})
    same = F.lit(True)
    for k in pane:
        same = same & F.col(k).eqNullSafe(F.col("\0key_" + k))
    # Without panes one row is joined.
    return (df.join(found, same, "left") if pane else df.crossJoin(found)).drop(*["\0key_" + k for k in pane])


def confidence_band(df: DataFrame, value: str, pane: list[str] = (), level: float = 0.95) -> DataFrame:
    """Interval of the mean, by the normal distribution."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return fixed(df, list(pane), {"band_low": F.avg(value) - half, "band_high": F.avg(value) + half})


def trend(df: DataFrame, x: str, y: str, groups: list[str] = (), kind: str = "linear") -> DataFrame:
    """Slope, intercept and R2 per group of y on x, linear in: x, y (linear); x, ln y (exponential); ln x, y (logarithmic); ln x, ln y (power)."""
    log_x, log_y = kind in ("logarithmic", "power"), kind in ("exponential", "power")
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    fx = F.when(cx > 0, F.ln(cx)) if log_x else cx
    fy = F.when(cy > 0, F.ln(cy)) if log_y else cy
    return df.groupBy(*groups).agg(F.regr_slope(fy, fx).alias("slope"), F.regr_intercept(fy, fx).alias("intercept"), F.regr_r2(fy, fx).alias("r2"), F.regr_count(fy, fx).alias("n"))


def parabola(df: DataFrame, x: str, y: str, groups: list[str] = ()) -> DataFrame:
    """Coefficients c0 + c1 x + c2 x^2 by least squares: power sums in one aggregate, then Cramer's rule."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = both.groupBy(*groups).agg(*[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(3)])
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])
    cols = [[F.col(f"s{i + j}") for i in range(3)] for j in range(3)]
    right = [F.col(f"t{i}") for i in range(3)]
    whole = det(*cols)
    return s.select(*groups, *[F.try_divide(det(*[right if k == j else cols[k] for k in range(3)]), whole).alias(f"c{j}") for j in range(3)])


def forecast(df: DataFrame, period: str, value: str, ahead: int, groups: list[str] = (), ignore_last: int = 0, level: float = 0.95) -> DataFrame:
    """A series' trend carried on for `ahead` periods (whole numbers), with a prediction interval."""
    last = fixed(df, list(groups), {"\0last": F.max(period)})
    used = last.filter(F.col(period) <= F.col("\0last") - ignore_last)
    z = NormalDist().inv_cdf(0.5 + level / 2)
    fit = used.groupBy(*groups).agg(F.regr_slope(value, period).alias("\0b"), F.regr_intercept(value, period).alias("\0a"), F.sqrt(F.try_divide(F.regr_syy(value, period) * (1 - F.regr_r2(value, period)), F.count(value) - 2)).alias("\0sd"), F.max("\0last").alias("\0last"))
    steps = fit.withColumn(period, F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead + ignore_last)), lambda i: F.col("\0last") - ignore_last + i)))
    at = F.col("\0a") + F.col("\0b") * F.col(period)
    return steps.select(*groups, period, at.alias("forecast"), (at - z * F.col("\0sd")).alias("low"), (at + z * F.col("\0sd")).alias("high"))


def holt_winters(df: DataFrame, period: str, value: str, ahead: int, group: str, season: int = 12, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2, ignore_last: int = 0, confidence: float = 0.95, kind: str = "additive") -> DataFrame:
    """Holt-Winters for each series of `group`, a series in one task: (group, period, forecast, low, high).

    kind: seasons that add or that multiply ("multiplicative"); a series shorter than two seasons has none. The last
    `ignore_last` periods are left out and forecast too. low and high are the prediction interval at `confidence`,
    from the errors of the one-step forecasts and the weights with which they carry on.
    """
    times, z = kind == "multiplicative", NormalDist().inv_cdf(0.5 + confidence / 2)

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(period)
        steps = ahead + ignore_last
        series = series.iloc[: max(len(series) - ignore_last, 1)]
        y = series[value].astype(float).tolist()
        m = season if len(y) >= 2 * season else 1
        trend_ = (sum(y[m : 2 * m]) - sum(y[:m])) / m / m if len(y) >= 2 * m else 0.0
        middle = sum(y[:m]) / m
        plain = [middle + trend_ * (i - (m - 1) / 2) for i in range(m)]
        neutral = 1.0 if times else 0.0
        seasonal = [(v / p if p else 1.0) if times else v - p for v, p in zip(y, plain, strict=False)] if m > 1 else [neutral]
        level_, errors = middle - trend_ * (m + 1) / 2, []
        for i, v in enumerate(y):
            before, s = level_, seasonal[i % m]
            errors.append(v - ((before + trend_) * s if times else before + trend_ + s))
            level_ = alpha * ((v / s if s else v) if times else v - s) + (1 - alpha) * (before + trend_)
            trend_ = beta * (level_ - before) + (1 - beta) * trend_
            if m > 1:
                seasonal[i % m] = gamma * ((v / level_ if level_ else 1.0) if times else v - level_) + (1 - gamma) * s
        sd = (sum(e * e for e in errors[m:]) / max(len(errors) - m, 1)) ** 0.5
        last, out, spread = int(series[period].iloc[-1]), [], 1.0
        for i in range(1, steps + 1):
            s = seasonal[(len(y) + i - 1) % m]
            at = (level_ + i * trend_) * s if times else level_ + i * trend_ + s
            half = z * sd * spread**0.5
            out.append((series[group].iloc[0], last + i, at, at - half, at + half))
            carried = alpha * (1 + i * beta) + (gamma * (1 - alpha) if m > 1 and i % m == 0 else 0.0)
            spread += carried * carried
        return pd.DataFrame(out, columns=[group, period, "forecast", "low", "high"])

    type_ = dict(df.dtypes)[group]
    return df.select(group, F.col(period).cast("long").alias(period), F.col(value).cast("double").alias(value)).groupBy(group).applyInPandas(run, f"`{group}` {type_}, `{period}` long, forecast double, low double, high double")


def clusters(df: DataFrame, variables: list[str], k: int | None = None, seed: int = 7, most: int = 6) -> DataFrame:
    """Rows with their cluster by k-means over scaled variables; without k, the one with the best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=variables, outputCol="\0raw", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="\0raw", outputCol="\0x", withMean=True).fit(rows).transform(rows)
    fitted = lambda n: KMeans(k=n, seed=seed, featuresCol="\0x", predictionCol="cluster").fit(rows).transform(rows)
    if k is None:
        judge = ClusteringEvaluator(featuresCol="\0x", predictionCol="cluster")
        k = max(range(2, most + 1), key=lambda n: judge.evaluate(fitted(n)))
    return fitted(k).drop("\0raw", "\0x")


def assigned(df: DataFrame, variables: list[str], centres: list[tuple[float, ...]]) -> DataFrame:
    """Rows with the number of the nearest of given centres (the first of equally near ones) and the squared distance to it;
    rows with a null variable have none."""
    apart = [sum(((F.col(v).cast("double") - float(c)) * (F.col(v).cast("double") - float(c)) for v, c in zip(variables, centre, strict=True)), F.lit(0.0)) for centre in centres]
    near = F.array_min(F.array(*[F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(i).alias("i"))) for i, d in enumerate(apart)]))
    return df.withColumn("\0near", near).withColumns({"cluster": F.col("\0near.i"), "distance": F.col("\0near.d")}).drop("\0near")


def histogram(df: DataFrame, value: str, size: float) -> DataFrame:
    """Counts by bin; empty bins have no row."""
    return df.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / size) * size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
