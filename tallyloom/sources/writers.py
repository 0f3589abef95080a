"""Sinks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .readers import TYPES, jdbc_options


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).saveAsTable(name)


def ddl(name: str, columns: dict[str, str], required: set[str] = frozenset(), kind: str = "parquet") -> str:
    """CREATE TABLE with types and nullability."""
    cols = ", ".join(f"`{c}` {TYPES[t].upper()}{' NOT NULL' if c in required else ''}" for c, t in columns.items())
    return f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {kind}"


def create_table(spark: SparkSession, name: str, columns: dict[str, str], required: set[str] = frozenset()) -> None:
    spark.sql(ddl(name, columns, required))


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_jdbc(df: DataFrame, kind: str, types: str | None = None, mode: str = "overwrite", **where) -> None:
    """Write to a table of a database, each partition over its own connection; `types` are SQL types by column."""
    writer = df.write.format("jdbc").mode(mode).options(**jdbc_options(kind, **where))
    (writer.option("createTableColumnTypes", types) if types else writer).save()


def save_outputs(outputs: dict[str, tuple[DataFrame, str, str]], shared: list[DataFrame] = ()) -> None:
    """Write each named output as (frame, kind, target): parquet, csv, table or view. Shared frames are computed once."""
    for df in shared:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    for df, kind, target in outputs.values():
        if kind == "table":
            save_table(df, target)
        elif kind == "csv":
            save_csv(df, target)
        elif kind == "view":
            df.createOrReplaceTempView(target)
        else:
            df.write.mode("overwrite").parquet(target)
    for df in shared:
        df.unpersist()
