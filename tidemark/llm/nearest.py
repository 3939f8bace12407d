"""Matching records by nearest time: tick expansion and an equi-join (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a discrete tick, and of the coarse ticks in which the two sides first meet, in microseconds.
TICK_US, COARSE_US = 1_000_000, 60_000_000


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_at: str, right_at: str, left_id: str, right_id: str,
    tolerance_us: int, tick_us: int = TICK_US, coarse_us: int = COARSE_US,
) -> DataFrame:
    """(``left_id``, ``right_id``): for each row of ``left`` the row of ``right`` of the same entity that is nearest
    in time, at most ``tolerance_us`` away; of equally near ones the smallest ``right_id``.

    Time is cut into discrete ticks of ``tick_us``. Every right record is exploded to the ticks within tolerance of it
    that a left record stands in; which those are comes from an equi-join with the left ticks held by coarse tick, so
    a right record far from all left ones is never copied. An aggregation keeps what can be nearest to an entity-tick:
    the last record before it, the first after it, and the distinct instants within it (at most ``tick_us`` of them,
    one id each). The left records then meet their tick by an equi-join on (entity, tick) and take the nearest of
    what it holds, so the result is exact to the microsecond whatever the length of a tick. A hot entity is split
    along time, no pairs are formed, and both joins use the partitioning of the coarse ticks.

    Rows with null entity or time match nothing and give no row; repeated left rows give a row each, repeated right
    rows change nothing; empty tables give none. Ids must be bigint; other columns of whatever names are left alone.
    """
    if tolerance_us < 0 or tick_us <= 0 or coarse_us % tick_us:
        raise ValueError("tolerance_us must be 0 or more, tick_us positive, coarse_us a multiple of it")
    at = F.col("at")

    def tick(micros: Column, length: int) -> Column:
        return F.floor(micros / F.lit(length))

    lefts = left.select(F.col(entity).alias("e"), F.col(left_at).cast("bigint").alias("at"), F.col(left_id).cast("bigint").alias("lid"))
    lefts = lefts.where("e is not null and at is not null").withColumns({"coarse": tick(at, coarse_us), "tick": tick(at, tick_us)})
    rights = right.select(F.col(entity).alias("e"), F.col(right_at).cast("bigint").alias("at"), F.col(right_id).cast("bigint").alias("rid"))
    rights = rights.where("e is not null and at is not null and rid is not null")
    rights = rights.withColumn("coarse", F.explode(F.sequence(tick(at - tolerance_us, coarse_us), tick(at + tolerance_us, coarse_us))))
    # a coarse tick has at most coarse_us / tick_us ticks
    held = lefts.groupBy("e", "coarse").agg(F.collect_set("tick").alias("ticks"))
    near = F.filter("ticks", lambda t: t.between(tick(at - tolerance_us, tick_us), tick(at + tolerance_us, tick_us)))
    copies = rights.join(held, ["e", "coarse"]).select("e", "coarse", "at", "rid", F.explode(near).alias("tick"))
    once = copies.groupBy("e", "coarse", "tick", "at").agg(F.min("rid").alias("rid"))
    starts, own = F.col("tick") * tick_us, tick(at, tick_us)
    record = F.struct("at", "rid")
    kept = once.groupBy("e", "coarse", "tick").agg(
        F.max(F.when(at < starts, record)).alias("before"),
        F.min(F.when(at >= starts + tick_us, record)).alias("after"),
        F.collect_list(F.when(own == F.col("tick"), record)).alias("within"),
    )

    def gap(r: Column) -> Column:
        return F.struct(F.abs(r["at"] - at).alias("gap"), r["rid"].alias("rid"))

    def one(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), gap(F.col(c)))

    best = F.least(one("before"), one("after"), F.array_min(F.transform("within", gap)))
    met = lefts.join(kept, ["e", "coarse", "tick"]).select(F.col("lid").alias(left_id), best.alias("__best"))
    return met.where(F.col("__best.gap") <= tolerance_us).select(left_id, F.col("__best.rid").alias(right_id))
