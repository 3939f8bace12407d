"""Splits, gates and tests that decide whether a pair or a result is kept."""

from __future__ import annotations

import math
from datetime import date
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pairs import half_life, johansen_trace, pair_statistics
from tidemark.operators.windows import correlation, running_total


def split_periods(df: DataFrame, day: str, formation: tuple[str, str], trading: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the formation and of the trading period (both ends included); the first must end before the second begins."""
    if date.fromisoformat(formation[1]) >= date.fromisoformat(trading[0]):
        raise ValueError("the formation period must end before the trading period begins")
    part = lambda p: df.where(F.col(day).between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date")))
    return part(formation), part(trading)


def correlation_gate(pairs: DataFrame, keys: list[str], order: str, cuts: list[Column], floor: float, decay: float) -> DataFrame:
    """``gate`` per pair: 'missing' if a block has no correlation, 'floor' if the last is below it, 'decay' if they fall
    from block to block by ``decay`` in all, else 'kept'. Blocks are the spans between ``cuts``; one aggregation."""
    block = F.lit(1)
    for c in cuts:
        block = block + (F.col(order) >= c).cast("int")
    n = len(cuts) + 1
    each = [correlation(F.when(F.col("__b") == k, F.col("a")), F.when(F.col("__b") == k, F.col("b"))).alias(f"c{k}") for k in range(1, n + 1)]
    c = pairs.withColumn("__b", block).groupBy(*keys).agg(*each)
    cs = [F.col(f"c{k}") for k in range(1, n + 1)]
    missing, falling = F.lit(False), F.lit(True)
    for x in cs:
        missing = missing | x.isNull() | F.isnan(x)
    for x, y in zip(cs, cs[1:]):
        falling = falling & (x > y)
    gate = F.when(missing, "missing").when(cs[-1] < floor, "floor").when(falling & (cs[0] - cs[-1] >= decay), "decay").otherwise("kept")
    return c.select(*keys, gate.alias("gate"))


def temporal_gate(
    pairs: DataFrame, keys: list[str], order: str, blocks: int, bars_per_day: float, least: int = 40, drift: float = 0.3,
    shift: float = 1.0, level: float = 0.05, passes: int = 2, half_lives: tuple[float, float] = (1.0, 10.0),
) -> DataFrame:
    """``gate`` per pair of rows (keys, ``order``, block from 1, a, b): the first rule that turns it down, else 'kept'.

    'missing': a block of under ``least`` rows or without a hedge ratio, or a spread that doesn't vary. 'drift': a block's
    principal-component hedge ratio is off the whole's by more than ``drift`` of it. 'shift': the mean spread (by the
    whole's ratio) moves by more than ``shift`` of its deviation from block to block. 'cointegration': fewer than
    ``passes`` blocks have a Johansen p-value below ``level``. 'half-life': a block's half-life in days lies outside
    ``half_lives`` or it doesn't revert. Every statistic is an aggregation by pair and block."""
    by = [*keys, "block"]
    whole = pair_statistics(pairs, keys).select(*keys, "alpha_pca", "beta_pca")
    spread = pairs.join(whole, keys).withColumn("spread", F.col("a") - F.col("alpha_pca") - F.col("beta_pca") * F.col("b"))
    dev = spread.groupBy(*keys).agg(F.stddev_samp("spread").alias("dev"))
    each = pair_statistics(pairs, by).select(*by, "n", F.col("beta_pca").alias("beta"))
    each = each.join(spread.groupBy(*by).agg(F.avg("spread").alias("mean")), by).join(half_life(spread, by, order).select(*by, (F.col("half_life") / bars_per_day).alias("days")), by)
    each = each.join(johansen_trace(pairs, by, order).select(*by, "p_value"), by).join(whole, keys).join(dev, keys)
    before = F.lag("mean").over(Window.partitionBy(*keys).orderBy("block"))
    each = each.withColumn("moved", F.abs(F.col("mean") - before) / F.col("dev"))
    c = each.groupBy(*keys).agg(
        F.count_if((F.col("n") >= least) & F.col("beta").isNotNull() & (F.col("dev") >= 1e-10)).alias("full"),
        F.max(F.abs(F.col("beta") - F.col("beta_pca")) / (F.abs("beta_pca") + 1e-10)).alias("drift"), F.max("moved").alias("shift"),
        F.count_if(F.col("p_value") < level).alias("passed"), F.count_if(F.col("days").between(*half_lives)).alias("in_range"),
    )
    gate = (
        F.when((F.col("full") < blocks) | F.col("drift").isNull(), "missing").when(F.col("drift") > drift, "drift").when(F.col("shift") > shift, "shift")
        .when(F.col("passed") < passes, "cointegration").when(F.col("in_range") < blocks, "half-life").otherwise("kept")
    )
    return c.select(*keys, gate.alias("gate"))


def valid_gate(pairs: DataFrame, keys: list[str], order: str, least: int = 20, level: float = 0.05) -> DataFrame:
    """``gate`` per pair of rows with ``block`` 1 (formation) and 2 (validation): 'missing' if a block has under ``least``
    rows or no statistic, 'formation' or 'validation' if the Johansen p-value there isn't below ``level``, else 'kept'."""
    rows = pairs.groupBy(*keys, "block").agg(F.count("*").alias("rows"))
    t = johansen_trace(pairs, [*keys, "block"], order).select(*keys, "block", "p_value")
    p = F.when((F.col("rows") >= least), F.col("p_value"))
    c = rows.join(t, [*keys, "block"], "left").groupBy(*keys).agg(*[F.max(F.when(F.col("block") == k, p)).alias(f"p{k}") for k in (1, 2)])
    gate = F.when(F.col("p1").isNull() | F.col("p2").isNull(), "missing").when(F.col("p1") >= level, "formation").when(F.col("p2") >= level, "validation").otherwise("kept")
    return c.select(*keys, gate.alias("gate"))


def exact_quantiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, n, quantiles): interpolated quantiles of ``value`` per key; null and NaN values don't count.

    Values are counted before they move, and the running count is carried over range partitions, so a hot key is spread
    however many values it has; at most two rows per share are left to put together."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = running_total(counts, [key], "v", "c", "upto")
    total = counts.groupBy(F.col(key).alias("__k")).agg(F.sum("c").alias("n"))
    counts = counts.join(total, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    places = {k: (F.col("n") - 1) * s for k, s in enumerate(shares)}

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("c")), F.col("v")))

    ends = [at(f(x)).alias(f"{c}{k}") for k, x in places.items() for c, f in (("lo", F.floor), ("hi", F.ceil))]
    q = counts.groupBy(key).agg(F.max("n").alias("n"), *ends)
    values = [F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (x - F.floor(x)) for k, x in places.items()]
    return q.select(key, "n", F.array(*values).alias("quantiles"))


def auroc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """(positive, negative, auroc): the counts, and the chance that a positive row scores above a negative one, ties half
    (Mann-Whitney over the product of counts; null if there is none of either). Rows with null in either don't count.

    Rows are counted per score first; ranks are running counts over the distinct scores, carried over range partitions."""
    s = df.where(F.col(positive).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    s = running_total(s, [], "s", "q", "upto")
    s = s.withColumn("u", F.col("p") * (F.col("upto") - F.col("q") / 2))
    return s.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positive"), F.coalesce(F.sum("q"), F.lit(0)).alias("negative"), F.try_divide(F.sum("u"), F.sum("p") * F.sum("q")).alias("auroc"))


def adf_statistic(x: np.ndarray, most_lags: int) -> tuple[float, int]:
    """Augmented Dickey-Fuller t-statistic without constant (for residuals), its lag chosen by AIC on common rows."""
    d = np.diff(x)
    best, chosen = math.inf, 0

    def fit(lags: int, skip: int) -> tuple[float, float]:
        y = d[skip:]
        cols = [x[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)]
        z = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        rest = y - z @ beta
        sse, n, k = float(rest @ rest), len(y), z.shape[1]
        se = math.sqrt(max(sse / (n - k) * np.linalg.pinv(z.T @ z)[0, 0], 1e-300))
        return n * math.log(max(sse / n, 1e-300)) + 2 * k, beta[0] / se

    most = max(0, min(most_lags, len(d) // 2 - 2))
    for lags in range(most + 1):
        aic, _ = fit(lags, most)
        if aic < best:
            best, chosen = aic, lags
    return fit(chosen, chosen)[1], chosen


# ---- fixed values: response surface of the 5 % critical value, two variables with a constant -----------------
_CRITICAL_5 = (-3.33613, -6.1101, -6.823)
# ---- end of fixed values ------------------------------------------------------------------------------------


def engle_granger(pairs: DataFrame, keys: list[str], order: str, most_lags: int = 30) -> DataFrame:
    """(keys, n, lags, statistic, cointegrated): regression of a on b, and the Dickey-Fuller test of its residual.

    One group per pair, of the length of its calendar. Pairs of under 30 rows give a null statistic and verdict."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        n, head = len(pdf), pdf.loc[:0, keys].reset_index(drop=True)
        if n < 30:
            return head.assign(n=n, lags=None, statistic=None, cointegrated=None)
        a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        z = np.column_stack([np.ones(n), b])
        rest = a - z @ np.linalg.lstsq(z, a, rcond=None)[0]
        t, lags = adf_statistic(rest, most_lags)
        critical = _CRITICAL_5[0] + _CRITICAL_5[1] / n + _CRITICAL_5[2] / n**2
        return head.assign(n=n, lags=lags, statistic=t, cointegrated=bool(t < critical))

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(test, f"{kinds}, n bigint, lags int, statistic double, cointegrated boolean")


def deflated_ratio(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over deviation per key, and the probability that it beats the best of as many ratios of chance.

    The moments are one aggregation; the normal distribution is applied to a row per key. Keys of fewer than three
    results, or without deviation, give null."""
    m = results.groupBy(*keys).agg(
        F.count(value).alias("n"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("ratio"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")
    )
    tried = m.agg(F.count("*").alias("tried"))
    kinds = ", ".join(f"`{k}` {results.schema[k].dataType.simpleString()}" for k in keys)
    normal = NormalDist()

    def deflate(batches):
        for pdf in batches:
            out = []
            for n, r, s, k, t in zip(pdf["n"], pdf["ratio"], pdf["skew"], pdf["kurt"], pdf["tried"]):
                if n < 3 or pd.isna(r) or pd.isna(s) or pd.isna(k):
                    out.append(None)
                    continue
                bar = normal.inv_cdf(1 - 1 / t) / math.sqrt(n) if t > 1 else 0.0
                spread = math.sqrt(max(1 - s * r + (k + 2) / 4 * r * r, 1e-12))
                out.append(round(normal.cdf((r - bar) * math.sqrt(n - 1) / spread), 9))
            yield pdf[keys].assign(n=pdf["n"], ratio=pdf["ratio"], deflated=out)

    return m.join(F.broadcast(tried)).mapInPandas(deflate, f"{kinds}, n bigint, ratio double, deflated double")
