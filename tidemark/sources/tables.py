"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many rows; beyond it the join shuffles.
SMALL_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``most`` rows, which is counted, not assumed; else a sort-merge join.

    The second hint matters: the planner judges a Parquet table by its compressed size, and a well compressed one can
    be a hundred times that in memory.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table over all cores: one of fewer partitions than cores (a small file is a single one) is dealt out
    before work is done on it; any larger table stays as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
