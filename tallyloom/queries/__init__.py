"""Registered queries over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import business, governance, grouping, scalars, shaping, windows  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by segment and year, its share of the year, and the segment's first order among customers' first orders."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Both facts are brought to the grain of orders and customers before they meet.
    value = read("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    per_year = value.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("value").alias("value"))
    first = orders.groupBy(F.col("o_custkey").alias("first_of")).agg(F.min("o_orderdate").alias("first_order"))
    customers = read("customer").select("c_custkey", "c_mktsegment").join(first, F.col("c_custkey") == F.col("first_of"))
    grid = per_year.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "year").agg(F.sum("value").alias("revenue"), F.to_date(F.min("first_order")).alias("first_order"))
    shared = grid.withColumn("share", F.round(F.col("revenue") / F.sum("revenue").over(Window.partitionBy("year")), 6))
    return shared.withColumn("revenue", F.round("revenue", 2)).orderBy("year", "c_mktsegment")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """
SELECT c_mktsegment, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(min(f) AS DATE) AS first_order,
       round(sum(l_extendedprice * (1 - l_discount)) / sum(sum(l_extendedprice * (1 - l_discount))) OVER (PARTITION BY year(o_orderdate)), 6) AS share
FROM lineitem JOIN (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS f FROM orders) ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2
"""
