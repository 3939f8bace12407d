"""Mixed timestamp formats and time zones: every text to one unambiguous form (problem 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.instants import with_instant, with_session_date
from tidemark.sources.tables import broadcast_if_small


def with_source_clock(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """Adds ``__zone`` and ``__order``, the default zone and date order of each row's ``feed``.

    ``feeds`` may repeat a feed (its first row by zone counts); a feed it doesn't list, or null, gets null, so only
    texts that need no default name an instant there. Columns of ``df`` of whatever names are left alone.
    """
    known = (
        feeds.where(F.col("feed").isNotNull())
        .groupBy(F.col("feed").alias("__feed"))
        .agg(F.min(F.struct("clock_zone", "date_order")).alias("__clock"))
        .select("__feed", F.col("__clock.clock_zone").alias("__zone"), F.col("__clock.date_order").alias("__order"))
    )
    return df.join(broadcast_if_small(known), df["feed"] == F.col("__feed"), "left").drop("__feed")


def instants(df: DataFrame, feeds: DataFrame, text: str, out: str, canonical: str | None = None, **policy: str) -> DataFrame:
    """``df`` with the instant of ``text`` in microseconds since 1970 UTC (see ``with_instant``)."""
    clocked = with_source_clock(df, feeds)
    return with_instant(clocked, text, out, "__zone", "__order", canonical, **policy).drop("__zone", "__order")


def session_dates(df: DataFrame, feeds: DataFrame, text: str, out: str, canonical: str | None = None) -> DataFrame:
    """``df`` with the session date of ``text`` (see ``with_session_date``)."""
    clocked = with_source_clock(df, feeds)
    return with_session_date(clocked, text, out, "__zone", "__order", canonical).drop("__zone", "__order")


def spelled_otherwise(sources: list[tuple[str, DataFrame, str, str, str]], feeds: DataFrame) -> DataFrame:
    """Rows whose text names a time but isn't its canonical spelling, as (src_table, row_id, utc_us).

    ``sources``: (name, table, id column, text column, ``instant`` or ``date``). For dates ``utc_us`` is 00:00 UTC of
    the session date. Texts that name nothing, nulls included, give no row; repeated rows give a row each; empty
    tables give none. One pass over each table, no shuffle.
    """
    parts = []
    for kind in ("instant", "date"):
        slim = [
            df.select(F.lit(name).alias("src_table"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("__text"), "feed")
            for name, df, key, text, k in sources
            if k == kind
        ]
        if not slim:
            continue
        rows = reduce(DataFrame.unionByName, slim)  # read by one plan, not by one per source
        if kind == "instant":
            found = instants(rows, feeds, "__text", "utc_us", "__canonical")
        else:
            found = session_dates(rows, feeds, "__text", "__date", "__canonical")
            found = found.withColumn("utc_us", F.unix_date("__date").cast("bigint") * 86_400_000_000)
        found = found.where(F.col("utc_us").isNotNull() & ~F.coalesce("__canonical", F.lit(False)))
        parts.append(found.select("src_table", "row_id", "utc_us"))
    return reduce(DataFrame.unionByName, parts)
