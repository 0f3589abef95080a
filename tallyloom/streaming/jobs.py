"""Streams: alerts, throttling, metrics, service levels and file loads. The same functions take batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.joins import buffered

#: How long an alert stays silent after it was raised.
THROTTLE = {"hourly": ("hour", "1 hour"), "daily": ("day", "1 day")}


def alerts(readings: DataFrame, rules: DataFrame, key: str, value: str) -> DataFrame:
    """Readings that break a rule: rules are (rule, key, operator, threshold), read once and broadcast if they are found small."""
    named = rules.select("rule", F.col("key").alias("\0key"), "operator", F.col("threshold").cast("double").alias("threshold"))
    both = readings.join(buffered(named), F.col(key) == F.col("\0key"))
    v, t, o = F.col(value), F.col("threshold"), F.col("operator")
    hit = F.when(o == ">", v > t).when(o == "<", v < t).when(o == ">=", v >= t).when(o == "<=", v <= t).when(o.isin("=", "=="), v == t).when(o.isin("!=", "<>"), v != t)
    return both.filter(hit).drop("\0key")


def throttled(raised: DataFrame, how: str, time: str = "ts") -> DataFrame:
    """At most one alert of a rule in each hour or day, or a single one; in a stream, the state of an hour or day is
    dropped once the watermark has passed, and that of "once" is a row a rule."""
    if how == "once":
        return raised.dropDuplicates(["rule"])
    part, delay = THROTTLE[how]
    cut = raised.withColumn("alert_period", F.date_trunc(part, F.col(time)))
    if not raised.isStreaming:
        return cut.dropDuplicates(["rule", "alert_period"])
    return cut.withWatermark(time, delay).dropDuplicatesWithinWatermark(["rule", "alert_period"])


class _Silence(StatefulProcessor):
    """Of each rule, the alerts at least `micros` after the one raised last; None is silence for good."""

    def __init__(self, micros: int | None):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A rule's times of one batch are sorted: eight bytes an alert.
        times = np.sort(np.concatenate([b["micros"].to_numpy(np.int64) for b in rows]))
        until, raised = (self.until.get()[0] if self.until.exists() else None), []
        while len(times):
            at = 0 if until is None else int(np.searchsorted(times, until))
            if at == len(times):
                break
            raised.append(int(times[at]))
            until = np.iinfo(np.int64).max if self.micros is None else raised[-1] + self.micros
            times = times[at + 1 :]
        if raised:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.until.update((until,))
            if self.micros is not None:
                self.handle.registerTimer(until // 1000 + 1)
            yield pd.DataFrame({"rule": np.array([key[0]] * len(raised), object), "micros": np.array(raised, np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def silenced(raised: DataFrame, silence: str | None = None, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream of (rule, time): alerts of which each silences its rule for an interval such as "1 day"; None is once and for all.

    A state of one number a rule is kept, and dropped by a timer once the watermark has passed the end of its silence. Late
    alerts within a silence are silent, too. Needs run_once() with rocksdb, as the state has timers.
    """
    micros = None if silence is None else raised.sparkSession.sql(f"SELECT CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00+00:00' + INTERVAL {silence}) AS LONG)").first()[0]
    rows = raised.select("rule", F.col(time).alias("ts"), F.unix_micros(time).alias("micros")).filter("rule is not null and ts is not null").withWatermark("ts", late)
    out = rows.groupBy("rule").transformWithStateInPandas(_Silence(micros), "rule string, micros long", "append", "EventTime")
    return out.select("rule", F.timestamp_micros("micros").alias(time))


def metric(readings: DataFrame, time: str, every: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Count, sum and extremes by tumbling window and keys."""
    rows = readings.withWatermark(time, late) if readings.isStreaming else readings
    v = F.col(value)
    grid = rows.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))
    return grid.select(F.col("w.start").alias("window_start"), *keys, "n", "total", "low", "high")


def breaches(readings: DataFrame, time: str, every: str, keys: list[str], value: str, limit: float, late: str = "1 day") -> DataFrame:
    """Items and breaches of a service level by tumbling window."""
    rows = readings.withWatermark(time, late) if readings.isStreaming else readings
    grid = rows.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col(value) > limit).alias("breaches"))
    return grid.select(F.col("w.start").alias("window_start"), *keys, "items", "breaches")


def load_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema, kind: str = "parquet") -> None:
    """Append the files that came since the last call to a Parquet table, each once."""
    rows = spark.readStream.schema(schema).format(kind).load(source)
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


#: The state store that keeps states with timers and many rows on disk.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, target: str, checkpoint: str, rocksdb: bool = False) -> DataFrame:
    """Run a stream over all that is there, append what it gives to a Parquet table, and read that table.

    Without input the table is empty. The setting that `rocksdb` needs is put back when the run is over.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(target)
    before = spark.conf.get(ROCKSDB[0])
    try:
        if rocksdb:
            spark.conf.set(*ROCKSDB)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], before)
    return spark.read.schema(stream.schema).parquet(target)


def run_updates(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over all that is there; each batch's changed groups go to a Parquet table, the last
    version of a group is its result. Nothing but the groups' rows is written, and none of them by the driver."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch_", F.lit(batch).cast("long")).write.mode("append").parquet(target)

    kind = T.StructType([*stream.schema.fields, T.StructField("batch_", T.LongType())])
    stream.sparkSession.createDataFrame([], kind).write.mode("append").parquet(target)  # without input there is no batch
    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    last = stream.sparkSession.read.schema(kind).parquet(target).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("last_"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last_.`{c}`") for c in stream.columns])
