"""The document store: what is pushed down, what is skipped, what a failed write leaves."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import documents

KIND = "k long, name string, v double, at timestamp, day date, tags array<string>, deep struct<a:int>"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("é"), "id").alias("name"), F.when(F.col("id") % 10 != 0, F.col("id") / 2).alias("v"), F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5)).alias("at"), F.lit(datetime.date(2024, 1, 2)).alias("day"), F.array(F.lit("x")).alias("tags"), F.struct(F.col("id").cast("int").alias("a")).alias("deep"))
    documents.write(rows.coalesce(1), path, "c", rows_per_file=10)
    return path, rows


def test_round_trip_and_missing_fields(spark, store):
    path, rows = store
    assert sorted(map(tuple, documents.read(spark, path, "c", KIND).collect())) == sorted(map(tuple, rows.collect()))
    assert documents.read(spark, path, "c", "k long, other string").filter("other is null").count() == 100
    assert documents.read(spark, path, "nothing", KIND).count() == 0


def test_filters_skip_files(spark, store):
    path, _ = store
    schema = documents.read(spark, path, "c", KIND).schema
    reader = documents._Reader({"path": path, "collection": "c"}, schema)
    left = list(reader.pushFilters([documents.GreaterThan(("k",), 84), documents.EqualTo(("deep", "a"), 1), documents.IsNotNull(("v",))]))
    assert left == [documents.EqualTo(("deep", "a"), 1)] and len(reader.partitions()) == 2
    assert sorted(r.k for r in documents.read(spark, path, "c", KIND).filter("k > 84 and v is not null").collect()) == [k for k in range(85, 100) if k % 10]
    assert [r.name for r in documents.read(spark, path, "c", KIND).filter("name in ('é7', 'zzz') and k <> 3").collect()] == ["é7"]


def test_appends_overwrites_and_failures(spark, store):
    path, rows = store
    documents.write(rows.filter("k < 5"), path, "c")
    assert documents.read(spark, path, "c", KIND).count() == 105
    with pytest.raises(Exception):
        documents.write(rows.withColumn("bad", F.raise_error(F.lit("no")).cast("string")), path, "c")
    assert documents.read(spark, path, "c", KIND).count() == 105
    documents.write(rows.filter("k < 3"), path, "c", mode="overwrite")
    assert documents.read(spark, path, "c", KIND).count() == 3
    assert len([n for n in os.listdir(f"{path}/c") if n.startswith("_list-")]) == 1 and len([n for n in os.listdir(f"{path}/c") if n.endswith(".json")]) <= 4
