"""Bars and quotes from streams: windowed bars with late data, upserts by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import SCHEMA, upsert

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Replays Parquet files of ticks as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, window_start, open, high, low, close, volume) of each window; ticks later than ``late`` are left out of a stream.

    Ties in time are broken by the event id, so a batch and a stream give the same bars.
    """
    t = ticks.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    t = t.withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    bars = t.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("value").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("window_start"), "open", "high", "low", "close", "volume")


def upsert_into(path: str):
    """A ``foreachBatch`` function that merges bars (symbol, sector, date, ...) into a Parquet table of months.

    Only the months that a batch touches are read and written anew, as the batch's version; then a pointer names the version of each
    of them. A batch that is lost before that leaves the table as it was, and a repeated one writes the same again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        month = F.date_format("date", "yyyy-MM")
        months = [r[0] for r in batch.where("date IS NOT NULL").select(month).distinct().collect()]  # a batch's few months
        if not months:
            return
        old = current(spark, path, months, batch_id)
        upsert(old, batch.select(*old.columns)).withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(f"{path}/v{batch_id}")
        spark.createDataFrame([(m, batch_id) for m in months], "month string, version long").coalesce(1).write.mode("append").json(f"{path}/pointer")

    return merge


def current(spark: SparkSession, path: str, months: list[str] | None = None, before: int | None = None) -> DataFrame:
    """The table's bars by the last version of each month (below ``before``)."""
    try:
        pointer = spark.read.schema("month string, version long").json(f"{path}/pointer")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], SCHEMA)
    if before is not None:
        pointer = pointer.where(F.col("version") < before)
    found = {r["month"]: r["v"] for r in pointer.groupBy("month").agg(F.max("version").alias("v")).collect()}  # one row a month
    folders = [f"{path}/v{v}/month={m}" for m, v in sorted(found.items()) if months is None or m in months]
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
