"""File sources and sinks: partitioned tables, dated CSV files, logs, snapshots, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.bars import first_or_last
from tidemark.sources.scratch import fresh_path

_NAME = r"^(.*)_(\d{4}-\d{2}-\d{2})\.csv$"


def dated_csv(spark: SparkSession, path: str, schema: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """CSV files named ``<ticker>_<date>.csv`` with columns ``ticker`` and ``day`` from the name, within [start, end].

    The dates are compared on the file's name in the scan's metadata, so files outside are dropped before they are read.
    """
    name = F.col("_metadata.file_name")
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select("*", F.regexp_extract(name, _NAME, 1).alias("ticker"), F.regexp_extract(name, _NAME, 2).cast("date").alias("day"))
    if start:
        df = df.where(F.col("day") >= F.lit(start).cast("date"))
    return df.where(F.col("day") <= F.lit(end).cast("date")) if end else df


def tickers_of(spark: SparkSession, path: str) -> DataFrame:
    """The tickers that have a dated file, from the names alone."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.select(F.regexp_extract("name", _NAME, 1).alias("ticker")).where("ticker <> ''").distinct()


def utc_nanoseconds(c: str) -> Column:
    """Nanoseconds since 1970 as a timestamp."""
    return F.timestamp_micros((F.col(c) / 1000).cast("bigint"))


def numeric_with_markers(c: str, markers: tuple[str, ...] = ("halted",)) -> tuple[Column, Column]:
    """(number or null, flag) of a text column that holds numbers with thousands commas and marker words."""
    t = F.trim(F.col(c))
    flag = F.coalesce(F.lower(t).isin(*markers), F.lit(False))
    return F.regexp_replace(t, ",", "").try_cast("double"), flag


def missing_columns(df: DataFrame, wanted: StructType) -> list[str]:
    """Columns of a contract that ``df`` lacks or has with another type."""
    has = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in wanted.fields if has.get(f.name) != f.dataType]


def write_by(df: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    """Write Parquet partitioned by ``keys``, rows of a partition together."""
    df.repartition(*keys).write.mode(mode).partitionBy(*keys).parquet(path)


class Snapshots:
    """A keyed table kept as versions in the shared folder: upserts write a new version, readers see a whole one."""

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], order: list[str]):
        self.spark, self.schema, self.keys, self.order = spark, schema, keys, order
        self.root, self.version = fresh_path(spark, "snapshots"), -1

    def read(self) -> DataFrame:
        """The table as of the last upsert."""
        if self.version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self.version}")

    def upsert(self, rows: DataFrame, only_new: bool = False) -> None:
        """Merge rows by key, the last by ``order`` winning; with ``only_new`` known keys stay as they are."""
        now = self.read()
        rows = first_or_last(rows.select(*now.columns), self.keys, self.order)
        if only_new:
            merged = now.unionByName(rows.join(now.select(*self.keys), self.keys, "left_anti"))
        else:
            merged = first_or_last(now.unionByName(rows), self.keys, self.order)
        merged.write.parquet(f"{self.root}/{self.version + 1}")
        self.version += 1


#: Lines of the audit log: time, level, event, the rest.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?) (INFO|WARN|ERROR) (\S+)(?: (.*))?$"


def log_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, level, event, rest) of text lines in the audit log's form; other lines give no row."""
    part = lambda k: F.regexp_extract(column, LOG_LINE, k)
    good = lines.where(F.col(column).rlike(LOG_LINE))
    return good.select(
        part(1).try_cast("timestamp").alias("at"), part(2).alias("level"), part(3).alias("event"),
        part(4).alias("rest"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """The text form of (at, level, event, rest)."""
    return events.select(F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd HH:mm"), "level", "event", F.nullif("rest", F.lit(""))).alias("value"))


def random_walk(spark: SparkSession, series: int, length: int, seed: int = 42) -> DataFrame:
    """(ticker, i, value): hash-driven random walks, the same for the same seed on any cluster."""
    from tidemark.operators.windows import over

    step = (F.pmod(F.xxhash64("ticker", "i", F.lit(seed)), F.lit(2_000_001)) - 1_000_000) / 1e8
    grid = spark.range(series).select(F.format_string("T%04d", "id").alias("ticker"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    return grid.withColumn("value", F.exp(F.sum(step).over(over(["ticker"], ["i"]))) * 100)
