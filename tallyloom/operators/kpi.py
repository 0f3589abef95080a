"""Business measures, scorecards, service levels and log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import by_name, ratio
from .quality import full_null_safe


def per_row(x: Column | str) -> Column:
    """Sum over rows: average length of stay, revenue per transaction."""
    return F.try_divide(F.sum(x), F.count(F.lit(1)))


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds."""
    return F.try_divide(F.count_if(condition), F.count(F.lit(1)))


def ratio_of_sums(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.sum(a), F.sum(b))


def mean(x: Column | str) -> Column:
    return F.avg(x)


def net(a: Column | str, b: Column | str) -> Column:
    return F.sum(a) - F.sum(b)


def variance_percent(actual: Column | str, budget: Column | str) -> Column:
    return F.try_divide(F.sum(actual) - F.sum(budget), F.sum(budget))


def per_distinct(x: Column | str, entity: Column | str) -> Column:
    """Items per basket."""
    return F.try_divide(F.sum(x), F.count_distinct(F.col(entity) if isinstance(entity, str) else entity))


def across(a: DataFrame, b: DataFrame, keys: list[str], numerator: Column, denominator: Column, new: str, scale: float = 1.0) -> DataFrame:
    """A ratio of measures of two facts: each is aggregated to the keys on its own, then they are joined and divided."""
    left, right = a.groupBy(*keys).agg(numerator.alias("\0a")), b.groupBy(*keys).agg(denominator.alias("\0b"))
    joined = full_null_safe(left, right, keys) if keys else left.crossJoin(right)  # one row each without keys
    return joined.select(*keys, (ratio(F.col("\0a"), F.col("\0b")) * scale).alias(new))


def same_store_growth(df: DataFrame, entity: str, period: str, value: str, now: object, before: object) -> DataFrame:
    """Growth over the entities present in both periods."""
    each = df.filter(F.col(period).isin([now, before])).groupBy(entity).agg(F.sum(F.when(F.col(period) == now, F.col(value))).alias("a"), F.sum(F.when(F.col(period) == before, F.col(value))).alias("b"))
    both = each.filter("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("stores"), F.sum("a").alias("now"), F.sum("b").alias("before"), F.try_divide(F.sum("a") - F.sum("b"), F.sum("b")).alias("growth"))


def lifetime_value(df: DataFrame, entity: str, value: str, by: list[str] = ()) -> DataFrame:
    """Mean over entities of their sums."""
    return df.groupBy(*by, entity).agg(F.sum(value).alias("\0v")).groupBy(*by).agg(F.avg("\0v").alias("lifetime_value"), F.count(F.lit(1)).alias("entities"))


def scorecard(df: DataFrame, date: str, metrics: list[dict]) -> DataFrame:
    """Metrics against targets: name, value column, aggregation, grain, target and an optional filter each.

    One scan for all: a row becomes one (metric, period, value) for each metric whose filter it meets, and one partial
    aggregate runs over them. Values of metrics that aggregate alike share a column.
    """
    kinds = list(dict.fromkeys(m["aggregation"] for m in metrics))
    cells = [
        F.when(F.lit(True) if m.get("filter") is None else m["filter"], F.struct(F.lit(i).alias("at"), F.to_date(F.date_trunc(m["grain"], date)).alias("period"), F.lit(m["aggregation"]).alias("kind"), F.col(m["value"]).cast("double").alias("value")))
        for i, m in enumerate(metrics)
    ]
    rows = df.select(F.inline(F.array_compact(F.array(*cells))))
    counted = rows.groupBy("at", "period").agg(*[by_name(k, F.when(F.col("kind") == k, F.col("value"))).cast("double").alias("\0" + k) for k in kinds])
    known = [F.struct(F.lit(m["name"]).alias("metric"), F.lit(float(m["target"])).alias("target"), F.col("\0" + m["aggregation"]).alias("value")) for m in metrics]
    out = counted.select("period", F.get(F.array(*known), F.col("at")).alias("m")).select("m.metric", "period", "m.value", "m.target")
    status = F.when(F.col("value") >= F.col("target"), "on target").when(F.col("value") >= 0.9 * F.col("target"), "at risk").otherwise("behind")
    return out.withColumn("status", status)


def sla(df: DataFrame, seconds: tuple[str, float] | None = None, score: tuple[str, float] | None = None, valid: str | None = None) -> DataFrame:
    """Whether each item meets its service level, and the reasons if not: too slow, low score, invalid."""
    checks = []
    if seconds:
        checks.append(F.when(F.col(seconds[0]) > seconds[1], F.lit("time")))
    if score:
        checks.append(F.when(F.col(score[0]) < score[1], F.lit("score")))
    if valid:
        checks.append(F.when(~F.coalesce(F.col(valid), F.lit(False)), F.lit("validation")))
    reasons = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("breaches", reasons).withColumn("compliant", F.size("breaches") == 0)


def sla_rate(checked: DataFrame, by: list[str] = ()) -> DataFrame:
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if("compliant").alias("met"), F.avg(F.col("compliant").cast("int")).alias("rate"))


def run_log(df: DataFrame, session: str, duration: str, error: Column, by: list[str] = ()) -> DataFrame:
    """Sessions, durations and errors of a log."""
    return df.groupBy(*by).agg(F.count_distinct(F.col(session)).alias("sessions"), F.sum(duration).alias("total_duration"), F.avg(duration).alias("avg_duration"), F.count_if(error).alias("errors"))


def bottlenecks(df: DataFrame, by: list[str], note: str) -> DataFrame:
    """Categories by number of issues, with the three smallest notes as samples."""
    issues = df.groupBy(*by).agg(F.count(F.lit(1)).alias("issues"))
    # Three rows a task and group at most reach the window: Spark limits the ranks before the shuffle.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(note))
    few = df.filter(F.col(note).isNotNull()).select(*by, note).distinct().withColumn("\0place", place).filter(F.col("\0place") <= 3)
    samples = few.groupBy(*[F.col(b).alias("\0" + b) for b in by]).agg(F.array_sort(F.collect_list(note)).alias("samples"))
    joined = issues.join(samples, [F.col(b).eqNullSafe(F.col("\0" + b)) for b in by], "left")
    return joined.select(*by, "issues", F.coalesce("samples", F.array().cast(samples.schema["samples"].dataType)).alias("samples")).orderBy(F.desc("issues"), *by)


def progress(x: Column | str) -> list[Column]:
    """Counts of done (80 and more), partial (above 0) and pending."""
    v = F.col(x) if isinstance(x, str) else x
    return [F.count_if(v >= 80).alias("done"), F.count_if((v > 0) & (v < 80)).alias("partial"), F.count_if(F.coalesce(v <= 0, F.lit(True))).alias("pending")]
