"""Window expressions with the null and minimum-count rules of rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise

FLOOR = 1e-10


def over(keys: list[str], order: list[str | Column], rows: tuple[int, int] | None = None) -> WindowSpec:
    """A window; ``rows`` counts from the current row, ``None`` is the whole partition up to it as usual."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(*rows) if rows else w


def log_return(value: str, w: WindowSpec, ts: str | None = None, most_gap_s: int | None = None) -> Column:
    """Logarithmic return; null where a value is not positive or the gap to the row before exceeds ``most_gap_s``."""
    before = F.lag(value).over(w)
    ok = (F.col(value) > 0) & (before > 0)
    if most_gap_s is not None:
        seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
        ok = ok & (seconds - F.lag(seconds).over(w) <= most_gap_s)
    return F.when(ok, F.ln(F.col(value) / before))


def zscore(x: Column, w: WindowSpec, least: int) -> Column:
    """(x - mean) / max(sample deviation, floor) over ``w``; null with fewer than ``least`` values or without x."""
    return F.when((F.count(x).over(w) >= least) & (F.count(x).over(w) > 1), (x - F.avg(x).over(w)) / F.greatest(F.stddev_samp(x).over(w), F.lit(FLOOR)))


def rolling(f, x: Column, w: WindowSpec, least: int) -> Column:
    """An aggregate over a frame; null with fewer than ``least`` values in it (null rows take up frame slots)."""
    return F.when(F.count(x).over(w) >= least, f(x).over(w))


def correlation(a: str | Column, b: str | Column, w: WindowSpec | None = None) -> Column:
    """Correlation of the rows that have both; null where one of them doesn't vary (the built-in raises there)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    parts = [F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)), F.stddev_pop(F.when(a.isNotNull(), b))]
    c, sa, sb = (p.over(w) for p in parts) if w is not None else parts
    return F.try_divide(c, sa * sb)


def slope(y: str | Column, x: str | Column) -> Column:
    """Least-squares slope of y on x over the rows that have both; null where x doesn't vary."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)))


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds ``run``, the number of the run of equal consecutive values (null equals null) within a key."""
    w = over(keys, order)
    fresh = F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(over(keys, order, (Window.unboundedPreceding, 0)))).drop("__fresh")


def drawdown(equity: str, keys: list[str], order: list[str]) -> Column:
    """equity / running maximum - 1."""
    return F.col(equity) / F.max(equity).over(over(keys, order, (Window.unboundedPreceding, 0))) - 1


def compounded(r: Column, keys: list[str], order: list[str]) -> Column:
    """Running product of 1 + r, r clipped above -1; null returns count as 0."""
    step = F.ln(1 + F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(-1 + 1e-9)))
    return F.exp(F.sum(step).over(over(keys, order, (Window.unboundedPreceding, 0))))


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and with the row in ``order`` within ``keys`` (none: of all rows).

    The rows are range-sorted by keys and order over all partitions and written once; a partition's sum by key is carried
    on to the ones after it, so neither a hot key nor the whole table ends up in one task. ``order`` must be distinct
    within a key."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = materialise(df.repartitionByRange(n, *keys, order).withColumn("__part", F.spark_partition_id()), "ranged")
    by = ["__part", *keys]
    parts = held.groupBy(*by).agg(F.sum(value).alias("__sum"))
    earlier = over(keys, ["__part"], (Window.unboundedPreceding, -1))  # a row per key and partition it reaches into
    parts = parts.select(*[F.col(k).alias(f"__{k}") for k in by], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    within = F.sum(value).over(over(by, [order], (Window.unboundedPreceding, 0)))
    joined = held.withColumn("__within", within).join(parts, on)
    return joined.withColumn(name, F.col("__before") + F.col("__within")).select(*df.columns, name)
