"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: White space of the contracts: blank and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark deletes a query's shuffle files as soon as the query is done, instead of when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    Nothing reads the shuffles behind a written table again, so their files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._stashed = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that stash() wrote and nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, df._stashed
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 10_000, size: int = 4 << 20) -> None:
    """Bound what one Arrow batch of whole texts holds in the JVM and in a Python worker; smaller settings stay.

    Spark reads these settings when it runs a plan, after a query has returned it, so they stay in place.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, everything else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
