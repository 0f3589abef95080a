"""Incremental refresh, change detection and merges over Parquet tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import dates


def refresh(df: DataFrame, path: str, date: str, anchor: datetime.date, grain: str = "month", last: int = 1, rolling: int | None = None, drop: bool = False) -> DataFrame:
    """Rewrite the last `last` periods of a table partitioned by period, and hide periods older than `rolling`.

    Only the partitions of those periods are overwritten. With `drop`, the files of older periods are deleted, once the new
    ones are committed; a rerun finds nothing left to delete. Returns the table within the rolling window.
    """
    start = dates.add(grain, -last + 1, dates.trunc(grain, F.lit(anchor)))
    part = dates.trunc(grain, F.col(date))
    fresh = df.withColumn("period", part).filter(F.col("period") >= start)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    spark = df.sparkSession
    if rolling is None:
        return spark.read.parquet(path)
    oldest = dates.add(grain, -rolling + 1, dates.trunc(grain, F.lit(anchor)))
    if drop:
        _expire(spark, path, str(spark.range(1).select(oldest.cast("date").cast("string")).first()[0]))
    return spark.read.parquet(path).filter(F.col("period") >= oldest)


def _expire(spark: SparkSession, path: str, oldest: str) -> list[str]:
    """Delete the folders of periods before `oldest` through the table's own file system; one name a period is looked at."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = []
    for entry in files.listStatus(where):
        name = entry.getPath().getName()
        # Periods are dates, or times at midnight whose colons are escaped: their first ten characters are in order.
        if entry.isDirectory() and name.startswith("period=") and name[7:8].isdigit() and name[7:17] < oldest:
            files.delete(entry.getPath(), True)
            gone.append(name)
    return gone


def first_load(df: DataFrame, path: str, date: str, grain: str = "month") -> None:
    df.withColumn("period", dates.trunc(grain, F.col(date))).write.mode("overwrite").partitionBy("period").parquet(path)


def changed(items: DataFrame, manifest: DataFrame, key: str, stamp: str, digest: str) -> DataFrame:
    """Items that are new, or whose time differs from the manifest's and whose content does too."""
    old = manifest.select(F.col(key).alias("\0k"), F.col(stamp).alias("\0t"), F.col(digest).alias("\0h"))
    both = items.join(old, F.col(key) == F.col("\0k"), "left")
    status = F.when(F.col("\0k").isNull(), "new").when(F.col(stamp).eqNullSafe(F.col("\0t")), "same").when(F.col(digest).eqNullSafe(F.col("\0h")), "touched").otherwise("changed")
    return both.withColumn("status", status).drop("\0k", "\0t", "\0h")


def update_manifest(manifest: DataFrame, seen: DataFrame, key: str, stamp: str) -> DataFrame:
    """The latest entry of each key."""
    rest = [c for c in manifest.columns if c != key]
    both = manifest.unionByName(seen.select(manifest.columns))
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, *[c for c in rest if c != stamp])).alias("\0r"))
    return latest.select(*[F.col(c) if c == key else F.col(f"\0r.{c}") for c in manifest.columns])


def merge(existing: DataFrame, incoming: DataFrame, key: str, protected: list[str] = (), observed: Observation | None = None) -> DataFrame:
    """Incoming values over existing ones, but for protected columns, where existing ones that differ are kept and counted.

    The column `conflicts` tells how many protected values of the row differed; a null key is a key. An observation gets
    rows, added, kept and conflicts of the whole table from the same pass that writes it.
    """
    a = existing.select(*[F.col(c).alias("\0a" + c) for c in existing.columns], F.lit(True).alias("\0old"))
    b = incoming.select(*[F.col(c).alias("\0b" + c) for c in incoming.columns], F.lit(True).alias("\0new"))
    both = a.join(b, F.col("\0a" + key).eqNullSafe(F.col("\0b" + key)), "full")
    old, new = (lambda c: F.col("\0a" + c)), (lambda c: F.col("\0b" + c) if c in incoming.columns else F.lit(None))
    pick = lambda c: F.coalesce(old(c), new(c)) if c in protected or c == key else F.coalesce(new(c), old(c))
    clash = lambda c: (old(c).isNotNull() & new(c).isNotNull() & (old(c) != new(c))).cast("int")
    count = sum((F.coalesce(clash(c), F.lit(0)) for c in protected if c in incoming.columns), F.lit(0))
    merged = both.select(*[pick(c).alias(c) for c in existing.columns], count.alias("conflicts"), "\0old", "\0new")
    if observed is not None:
        merged = merged.observe(observed, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("\0old").isNull()).alias("added"), F.count_if(F.col("\0new").isNull()).alias("kept"), F.coalesce(F.sum("conflicts"), F.lit(0)).cast("long").alias("conflicts"))
    return merged.drop("\0old", "\0new")


def versions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed, modified and unchanged keys of two versions."""
    from .quality import row_diff

    return row_diff(before, after, keys)
