"""Bars: resampling, calendars, grids, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(ticks: DataFrame, keys: list[str], bucket: Column, value: str, order: list[str], volume: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume, count and volume-weighted price per key and bucket (column ``ts``).

    Open and close follow ``order``, ties and all; null values don't count, a bucket without values gives no row.
    One shuffle with partial aggregation: no sort, so a hot key costs a row per map task.
    """
    at = F.struct(*order)
    size = F.lit(1.0) if volume is None else volume
    return (
        ticks.where(F.col(value).isNotNull())
        .groupBy(*keys, bucket.alias("ts"))
        .agg(
            F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
            F.sum(size).alias("volume"), F.count("*").alias("n"), F.try_divide(F.sum(F.col(value) * size), F.sum(size)).alias("vwap"),
        )
    )


def coarser(bars: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Bars of a longer period from bars of a shorter one; last close, summed volume."""
    return bars.groupBy(*keys, bucket.alias("period")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("n").alias("n"),
    )


def on_weekdays(daily: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """Every weekday between a key's first and last date, with 0 where it has none."""
    span = daily.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date)).where(F.weekday(date) < 5)
    return days.join(daily, [*keys, date], "left").select(*keys, date, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def missing_periods(bars: DataFrame, keys: list[str], ts: str, step: str = "1 hour") -> DataFrame:
    """Periods without a bar between the first and last bar of each key and day."""
    day = F.to_date(ts)
    span = bars.groupBy(*keys, day.alias("day")).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    grid = span.select(*keys, "day", F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(ts))
    return grid.join(bars.select(*keys, ts), [*keys, ts], "left_anti")


def first_or_last(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in ``order``, all columns of it. An aggregation, so hot keys don't sort."""
    pick = (F.max_by if last else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("r")).select("r.*")


def in_folds(rows: DataFrame, date: str, folds: DataFrame) -> DataFrame:
    """Rows with each fold whose [start, end] holds their date. ``folds`` (fold, start, end) is a schedule of tens of
    rows; the month equi-key keeps the join from being a nested loop over all folds."""
    spread = folds.select("*", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("__m"))
    return (
        rows.withColumn("__m", F.trunc(date, "month"))
        .join(F.broadcast(spread), "__m")
        .where(F.col(date).between(F.col("start"), F.col("end")))
        .drop("__m")
    )
