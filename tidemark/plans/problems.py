"""The pN_ queries of the general problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.instants import BLANKS, DAY_US
from tidemark.operators.intervals import merged_periods
from tidemark.operators.normalise_times import instants, session_dates, spelled_otherwise
from tidemark.operators.orphans import OrphanLedger, replay
from tidemark.operators.regular_grid import regular_series
from tidemark.operators.spikes import implausible
from tidemark.plans import instants_sql
from tidemark.sources.scratch import materialise
from tidemark.sources.tables import spread, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four tables whose text names a time in another than the canonical spelling."""
    sources = [
        ("ticks", spread(table(spark, sf_dir, "ticks").select("tick_id", "ts", "feed")), "tick_id", "ts", "instant"),
        ("bars", table(spark, sf_dir, "bars"), "bar_id", "ts_date", "date"),
        ("live_orders", table(spark, sf_dir, "live_orders"), "order_no", "filled_ts", "instant"),
        ("positions", table(spark, sf_dir, "positions"), "position_id", "entry_ts", "instant"),
    ]
    return spelled_otherwise(sources, table(spark, sf_dir, "feeds"))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular five-minute series of every ticker and New York date, missing periods imputed and marked."""
    ticks = spread(table(spark, sf_dir, "ticks").select("ticker", "ts", "price", "size", "feed").where("price > 0 and size > 0"))
    read = instants(ticks, table(spark, sf_dir, "feeds"), "ts", "us")
    return regular_series(read, "ticker", "us", "price", "size").withColumnRenamed("series", "ticker")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing five-minute periods of every ticker and New York date."""
    return p5_grid(spark, sf_dir).where("filled").select("ticker", "slot_start")


def pair_key(c: str) -> Column:
    """Pair ids are the same if equal after trimming and upper-casing."""
    return F.upper(F.btrim(F.col(c), F.lit(BLANKS)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous holding periods of every pair and the gaps between them."""
    feeds = table(spark, sf_dir, "feeds")
    rows = table(spark, sf_dir, "positions").select(pair_key("pair_id").alias("pair_id"), "entry_ts", "exit_ts", "feed")
    rows = instants(instants(rows, feeds, "entry_ts", "start_us"), feeds, "exit_ts", "end_us")
    return merged_periods(rows, "pair_id", "start_us", "end_us")


def orphan_ledger(spark: SparkSession, sf_dir: str) -> OrphanLedger:
    """The references of orders, positions and trades to pairs and positions, taken in as they came."""
    orders, positions = table(spark, sf_dir, "live_orders"), table(spark, sf_dir, "positions")
    trades, pairs = table(spark, sf_dir, "trades_eow"), table(spark, sf_dir, "pair_list")

    def refs(df: DataFrame, link: str, name: str, key: str, at: str) -> DataFrame:
        return df.select(
            F.lit(link).alias("link"), pair_key("pair_id").alias("key"), F.lit(name).alias("src_table"),
            F.col(key).cast("bigint").alias("row_id"), F.unix_micros(at).alias("at_us"),
        )

    references = (
        refs(orders, "pair_list", "live_orders", "order_no", "submitted_ts")
        .unionByName(refs(positions, "pair_list", "positions", "position_id", "recorded_ts"))
        .unionByName(refs(trades, "positions", "trades_eow", "trade_id", "snapshot_ts"))
    )
    listed = pairs.select(
        F.lit("pair_list").alias("link"), pair_key("pair_id").alias("key"),
        F.unix_micros("loaded_ts").alias("from_us"), F.unix_micros("removed_ts").alias("until_us"),
    ).withColumn("parent_id", F.to_json(F.struct("link", "key", "from_us", "until_us")))
    # of a pair's positions only the first recorded one matters: reduced before it moves
    held = (
        positions.select(F.lit("positions").alias("link"), pair_key("pair_id").alias("key"), F.unix_micros("recorded_ts").alias("from_us"))
        .groupBy("link", "key").agg(F.min("from_us").alias("from_us"))
        .withColumn("parent_id", F.to_json(F.struct("link", "key")))
    )
    parents = listed.select("parent_id", "link", "key", "from_us").unionByName(held.select("parent_id", "link", "key", "from_us"))
    return replay(spark, references, parents, listed.select("parent_id", "link", "key", "until_us"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to pairs or positions that don't exist at their time."""
    return orphan_ledger(spark, sf_dir).waiting().select("src_table", "row_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month, from the ledger's last snapshot."""
    ledger = orphan_ledger(spark, sf_dir)
    return ledger.snapshots().where(F.col("epoch") == ledger.epoch - 1).drop("epoch")


_P3_SQL = """
WITH pairs AS (SELECT upper(trim(pair_id)) AS k, loaded_ts, removed_ts FROM pair_list),
held AS (SELECT upper(trim(pair_id)) AS k, min(recorded_ts) AS since FROM positions GROUP BY 1),
found AS (
  SELECT 'live_orders' AS src_table, o.order_no AS row_id, o.submitted_ts AS at_ts FROM live_orders o
  WHERE o.pair_id IS NOT NULL AND o.submitted_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs p
    WHERE p.k = upper(trim(o.pair_id)) AND p.loaded_ts <= o.submitted_ts AND (p.removed_ts IS NULL OR o.submitted_ts < p.removed_ts))
  UNION ALL
  SELECT 'positions', o.position_id, o.recorded_ts FROM positions o
  WHERE o.pair_id IS NOT NULL AND o.recorded_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs p
    WHERE p.k = upper(trim(o.pair_id)) AND p.loaded_ts <= o.recorded_ts AND (p.removed_ts IS NULL OR o.recorded_ts < p.removed_ts))
  UNION ALL
  SELECT 'trades_eow', o.trade_id, o.snapshot_ts FROM trades_eow o
  WHERE o.pair_id IS NOT NULL AND o.snapshot_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h
    WHERE h.k = upper(trim(o.pair_id)) AND h.since <= o.snapshot_ts)
)
"""


#: How far away a spike lies, in typical steps, and how long a stuck run is.
SPIKE_LIMITS = {"bars|close": 20.0, "bars|volume": 10.0, "ticks|price": 20.0}
STUCK_RUNS = {"bars|close": ("sessions", 5), "bars|volume": ("sessions", 5), "ticks|price": ("readings", 10)}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that can't be right for their ticker: spikes, stuck values, impossible values."""
    feeds = table(spark, sf_dir, "feeds")
    ticks = table(spark, sf_dir, "ticks").select("tick_id", "ticker", "ts", "price", "feed")
    ticks = spread(ticks.where("ticker is not null and price is not null and not isnan(price)"))
    us = F.col("us")
    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), "America/New_York"))
    ticks = (
        instants(ticks, feeds, "ts", "us").where(us.isNotNull())
        .withColumn("local", local)
        .select(
            F.concat(F.lit("ticks|price|"), "ticker").alias("series"), us.alias("ord"), F.col("tick_id").alias("row_id"), F.col("price").alias("value"),
            F.floor(F.col("local") / DAY_US).cast("int").alias("day"),
            F.floor(F.col("local") / DAY_US).cast("int").alias("cell_row"),
            F.floor(F.pmod("local", F.lit(DAY_US)) / 3_600_000_000).cast("int").alias("cell_col"),
            F.lit(True).alias("by_day"),
        )
    )
    bars = table(spark, sf_dir, "bars").select("bar_id", "ticker", "ts_date", "close", "volume", "feed").where("ticker is not null")
    day = F.unix_date("date")
    bars = session_dates(bars, feeds, "ts_date", "date").where("date is not null")
    bars = bars.select("*", F.explode(F.create_map(F.lit("close"), "close", F.lit("volume"), "volume")).alias("field", "value"))
    bars = bars.where("value is not null and not isnan(value)").select(
        F.concat_ws("|", F.lit("bars"), "field", "ticker").alias("series"), day.cast("bigint").alias("ord"), F.col("bar_id").alias("row_id"), "value",
        day.alias("day"), F.floor((day + 3) / 7).cast("int").alias("cell_row"), F.pmod(day + 3, F.lit(7)).alias("cell_col"),
        F.lit(False).alias("by_day"),
    )
    readings = materialise(ticks.unionByName(bars), "dated")
    volume = F.col("series").startswith("bars|volume|")
    impossible = F.when(volume, F.col("value") < 0).otherwise(F.col("value") <= 0)
    level = F.when(volume, F.log1p("value")).otherwise(F.ln("value"))
    odd = implausible(readings.where(~impossible).withColumn("level", level), SPIKE_LIMITS, STUCK_RUNS, written=True)
    found = odd.select("series", "row_id").unionByName(readings.where(impossible).select("series", "row_id"))
    part = F.split("series", r"\|", 3)
    return found.select(part[0].alias("src_table"), "row_id", part[1].alias("field"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p5_grid": p5_grid, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found}
SQL: dict[str, str] = {
    "p4_found": instants_sql.P4,
    "p5_found": instants_sql.P5,
    "p6_found": instants_sql.P6,
    "p7_found": instants_sql.P7,
    "p3_found": _P3_SQL + "SELECT src_table, row_id FROM found",
    "p3_report": _P3_SQL + "SELECT src_table, strftime(at_ts AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS orphans FROM found GROUP BY 1, 2",
}
