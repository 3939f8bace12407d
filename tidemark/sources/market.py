"""Adapters from event and order tables to ticks, bars and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import resample
from tidemark.sources.tables import table


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: (event_id, ticker, user_id, ts, price, size); the size is read from the JSON properties."""
    e = table(spark, sf_dir, "events")
    size = F.from_json("props", "k double")["k"]
    return e.select("event_id", F.col("event_type").alias("ticker"), "user_id", "ts", F.col("value").alias("price"), size.alias("size"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of every event type."""
    return resample(event_ticks(spark, sf_dir), ["ticker"], F.date_trunc("hour", "ts"), "price", ["ts", "event_id"], F.col("size"))


def daily_panel(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """Daily last value of every user (or event type): (ticker, ts, value, volume)."""
    ticks = event_ticks(spark, sf_dir).withColumn("key", F.col(by))
    bars = resample(ticks, ["key"], F.to_date("ts"), "price", ["ts", "event_id"], F.col("size"))
    return bars.select(F.col("key").alias("ticker"), "ts", F.col("close").alias("value"), "volume")
