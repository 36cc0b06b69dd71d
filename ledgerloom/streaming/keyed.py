"""Streams that do what the batch operators do: latest record by key, each document once, windowed counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.tables import latest_per_key


def upsert_latest(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str):
    """Keeps the newest record of each key under `path`, one folder for each batch number.

    A batch reads the folder before its own, and writes its own whole: a batch that is run again after a failure gives the same
    folder, so records count once. Returns the running query; current(path) reads the newest folder."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        latest_per_key(rows, keys, *order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The newest batch of an upsert."""
    whole = spark.read.parquet(path)
    newest = whole.agg(F.max("batch")).first()[0]
    return whole.where(F.col("batch") == newest).drop("batch")


def stamped(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a time with a zone; one without is read in the session's."""
    return stream if dict(stream.dtypes)[time] == "timestamp" else stream.withColumn(time, F.col(time).cast("timestamp"))


def each_once(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """First record of each key; state is dropped once the watermark has passed."""
    return stamped(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, time: str, by: Sequence[str], width: str, value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window."""
    return stamped(stream, time).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def published(df: DataFrame, date: str, fy_end: str, lag_days: int = 60) -> DataFrame:
    """An unknown publication date is the year's end and a lag; its source is told."""
    known = F.col(date).isNotNull()
    return df.withColumns({f"{date}_source": F.when(known, "filing").otherwise("assumed"), date: F.coalesce(date, F.date_add(fy_end, lag_days))})
