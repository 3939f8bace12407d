"""As-of lookups: the last row at or before a time, per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], span: str = "day",
    fallback: dict[str, float] | None = None,
) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of the same key at or before ``at``, else ``fallback`` or null.

    Both sides are scanned together in order of time, without forming pairs. To keep a hot key from becoming one
    task the scan works within (key, ``span``); the last row of every earlier span, a row per key and span, is carried
    into the next ones by a second, small scan. Of right rows of the same time the last by ``values`` counts; a
    null value in the found row stays null unless a fallback is given.
    """
    lc = [c for c in left.columns]
    unit = F.date_trunc(span, F.col("__at"))
    found = F.struct(*values)
    l = left.select(F.col(key).alias("__k"), F.col(at).alias("__at"), F.struct(*[F.col(f"`{c}`") for c in lc]).alias("__row"), F.lit(None).cast(right.select(found.alias("v")).schema["v"].dataType).alias("__v"))
    r = right.select(F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), found.alias("__v")).where("__k is not null and __at is not null")
    both = l.unionByName(r).withColumn("__u", unit)
    ends = r.withColumn("__u", unit).groupBy("__k", "__u").agg(F.max(F.struct("__at", "__v")).alias("__e"))
    spans = both.select("__k", "__u").distinct().join(ends, ["__k", "__u"], "left")
    earlier = Window.partitionBy("__k").orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("__k", "__u", F.last("__e.__v", ignorenulls=True).over(earlier).alias("__c"))
    here = Window.partitionBy("__k", "__u").orderBy("__at", F.col("__row").isNotNull(), "__v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__s", F.last("__v", ignorenulls=True).over(here)).where(F.col("__row").isNotNull())
    out = seen.join(carried, ["__k", "__u"], "left").withColumn("__s", F.coalesce("__s", "__c"))
    fallback = fallback or {}
    return out.select("__row.*", *[F.coalesce(F.col("__s")[v], F.lit(fallback.get(v))).alias(v) for v in values])


def asof_many(left: DataFrame, right: DataFrame, probes: dict[str, tuple[str, str]], keys: list[str], value: str, **options) -> DataFrame:
    """Several as-of lookups per row in one pass: ``probes`` maps an output column to (key column, time column).

    The rows are unpivoted to one row per probe, looked up once, and pivoted back by ``keys`` (unique per row)."""
    parts = [left.select(*keys, F.lit(name).alias("probe"), F.col(k).alias("__key"), F.col(t).alias("__time")) for name, (k, t) in probes.items()]
    long = reduce(DataFrame.unionByName, parts)
    got = asof_backward(long, right.select(F.col(options.pop("right_key")).alias("__key"), F.col(options.pop("right_at")).alias("__time"), value), "__key", "__time", [value], **options)
    return got.groupBy(*keys).pivot("probe", list(probes)).agg(F.first(value))
