"""The stream operators over the events table, as a batch and as a replayed stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.bars import windowed_bars


def windowed_query(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # The sums of a window don't depend on the session's zone: starts are given as wall-clock text.
    got = windowed_bars(events)
    return got.select("symbol", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "open", "high", "low", "close", "volume")


def build() -> tuple[dict, dict]:
    k = "{'t': ts, 'i': event_id}"
    oracle = f"""SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, min_by(value, {k}) AS open, max(value) AS high, min(value) AS low, max_by(value, {k}) AS close, count(value) AS volume
FROM events GROUP BY event_type, date_trunc('hour', ts)"""
    return {"stream_windowed_bars": windowed_query}, {"stream_windowed_bars": oracle}
