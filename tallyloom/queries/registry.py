"""Registration of queries and their SQL twins by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes; event times carry a zone, as windows and watermarks need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def query(key: str, sql: str | None = None):
    """Register fn(tables) under an operator id and a short name, such as agg_01_group."""

    def put(fn):
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return put


def scalar(key: str, table: str, by: str, value: Callable[[], Column], sql: str) -> None:
    """Register one calculation over every row of a table: (by, v)."""
    query(key, f"SELECT {by}, {sql} AS v FROM {table}")(lambda t: getattr(t, table).select(by, value().alias("v")))


def r(x: Column, digits: int = 4) -> Column:
    """A double rounded for comparison."""
    return F.round(x.cast("double"), digits)
