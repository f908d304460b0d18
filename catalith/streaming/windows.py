"""Time windows over events; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), *keys, "events", "total")


def tumbling(events: DataFrame, length: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", watermark) if watermark else events
    return _flat(rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")), "event_type")


def sliding(events: DataFrame, length: str, slide: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", watermark) if watermark else events
    return _flat(rows.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")), "event_type")


def sessions(events: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("window"), key).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return _flat(grouped, key)
