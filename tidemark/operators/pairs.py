"""Pairs of series: alignment, hedge ratios, reversion, cointegration, selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import correlation, slope


def aligned_pairs(panel: DataFrame, ticker: str = "ticker", ts: str = "ts", value: str = "value") -> DataFrame:
    """All pairs of tickers a < b over the times both have a value: (ticker_a, ticker_b, ts, a, b).

    An equi-join on time: the panel is the relational form of the wide matrix, its output is the all-pairs problem
    itself. Statistics of pairs should be taken from ``pair_moments``, which sums before anything else is done.
    """
    x = panel.where(F.col(value).isNotNull()).select(F.col(ticker).alias("ticker"), F.col(ts).alias("ts"), F.col(value).alias("value"))
    a = x.select(F.col("ticker").alias("ticker_a"), "ts", F.col("value").alias("a"))
    b = x.select(F.col("ticker").alias("ticker_b"), "ts", F.col("value").alias("b"))
    return a.join(b, "ts").where("ticker_a < ticker_b").select("ticker_a", "ticker_b", "ts", "a", "b")


def pair_statistics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: observations, least-squares and principal-component hedge ratios, correlation, residual variance.

    The principal-component ratio is -v0/v1 of the smallest eigenvector of the 2x2 covariance, in closed form.
    """
    m = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), slope("a", "b").alias("beta_ols"), (F.avg("a") - slope("a", "b") * F.avg("b")).alias("alpha_ols"),
        correlation("a", "b").alias("corr"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("cab"),
        F.avg("a").alias("ma"), F.avg("b").alias("mb"),
    )
    least = (F.col("va") + F.col("vb")) / 2 - F.sqrt(F.pow((F.col("va") - F.col("vb")) / 2, 2) + F.pow("cab", 2))
    beta = F.when(F.abs("cab") > 1e-12, (F.col("va") - least) / F.col("cab"))
    m = m.withColumn("beta_pca", beta).withColumn("alpha_pca", F.col("ma") - F.col("beta_pca") * F.col("mb"))
    noise = F.col("va") - 2 * F.col("beta_pca") * F.col("cab") + F.pow("beta_pca", 2) * F.col("vb")
    return m.withColumn("noise", noise)


def half_life(spread: DataFrame, keys: list[str], order: str, value: str = "spread") -> DataFrame:
    """Half-life of mean reversion: the change regressed on the level before; null where it doesn't revert."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = spread.withColumn("__l", F.lag(value).over(w)).withColumn("__d", F.col(value) - F.col("__l"))
    k = s.groupBy(*keys).agg(slope("__d", "__l").alias("kappa"), F.count("__d").alias("n"))
    return k.withColumn("half_life", F.when(F.col("kappa") < 0, -math.log(2) / F.col("kappa")))


def johansen_trace(pairs: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Johansen trace statistic of two series (constant, one lagged difference) with its chi-squared(8) p-value.

    Everything is a function of second moments of (change, lagged change, lagged level), so it is one window and one
    aggregation in the JVM; the 2x2 eigenproblem is solved in closed form. Pairs with under 10 usable rows, or with
    singular moments, give null statistics.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = pairs
    for c in "ab":
        x = x.withColumn(f"l{c}", F.lag(c).over(w)).withColumn(f"d{c}", F.col(c) - F.lag(c).over(w))
    for c in "ab":
        x = x.withColumn(f"p{c}", F.lag(f"d{c}").over(w))
    x = x.where("pa is not null and pb is not null")
    names = ["da", "db", "la", "lb", "pa", "pb"]
    moments = [F.covar_pop(p, q).alias(f"{p}_{q}") for i, p in enumerate(names) for q in names[i:]]
    m = x.groupBy(*keys).agg(F.count("*").alias("n"), *moments)

    def cov(p: str, q: str) -> Column:
        return F.col(f"{p}_{q}" if names.index(p) <= names.index(q) else f"{q}_{p}")

    det = cov("pa", "pa") * cov("pb", "pb") - F.pow(cov("pa", "pb"), 2)

    def rest(p: str, q: str) -> Column:
        """Covariance of p and q after both are regressed on the lagged changes."""
        pa, pb, qa, qb = cov(p, "pa"), cov(p, "pb"), cov(q, "pa"), cov(q, "pb")
        fit = (pa * (cov("pb", "pb") * qa - cov("pa", "pb") * qb) + pb * (cov("pa", "pa") * qb - cov("pa", "pb") * qa)) / F.nullif(det, F.lit(0.0))
        return cov(p, q) - fit

    cols = {f"r_{p}_{q}": rest(p, q) for i, p in enumerate(names[:4]) for q in names[i:4]}
    m = m.withColumns(cols)
    r = {(p, q): F.col(f"r_{p}_{q}" if names.index(p) <= names.index(q) else f"r_{q}_{p}") for p in names[:4] for q in names[:4]}
    d0 = F.nullif(r["da", "da"] * r["db", "db"] - F.pow(r["da", "db"], 2), F.lit(0.0))
    d1 = F.nullif(r["la", "la"] * r["lb", "lb"] - F.pow(r["la", "lb"], 2), F.lit(0.0))
    # S11^-1 S10 S00^-1 S01: trace and determinant give both eigenvalues
    inv0 = [[r["db", "db"] / d0, -r["da", "db"] / d0], [-r["da", "db"] / d0, r["da", "da"] / d0]]
    inv1 = [[r["lb", "lb"] / d1, -r["la", "lb"] / d1], [-r["la", "lb"] / d1, r["la", "la"] / d1]]
    s10 = [[r[l, d] for d in ("da", "db")] for l in ("la", "lb")]
    m = m.withColumns({f"i0{i}{j}": inv0[i][j] for i in (0, 1) for j in (0, 1)} | {f"i1{i}{j}": inv1[i][j] for i in (0, 1) for j in (0, 1)} | {f"s{i}{j}": s10[i][j] for i in (0, 1) for j in (0, 1)})

    def mul(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
        return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] for j in (0, 1)] for i in (0, 1)]

    def grid(p: str) -> list[list[Column]]:
        return [[F.col(f"{p}{i}{j}") for j in (0, 1)] for i in (0, 1)]

    s = grid("s")
    m = m.withColumns({f"u{i}{j}": mul(grid("i1"), s)[i][j] for i in (0, 1) for j in (0, 1)} | {f"v{i}{j}": mul(grid("i0"), [[s[0][0], s[1][0]], [s[0][1], s[1][1]]])[i][j] for i in (0, 1) for j in (0, 1)})
    e = mul(grid("u"), grid("v"))
    m = m.withColumns({"__t": e[0][0] + e[1][1], "__d": e[0][0] * e[1][1] - e[0][1] * e[1][0]})
    root = F.sqrt(F.greatest(F.pow(F.col("__t") / 2, 2) - F.col("__d"), F.lit(0.0)))
    big, small = F.col("__t") / 2 + root, F.col("__t") / 2 - root
    usable = (F.col("n") >= 10) & (big < 1) & big.isNotNull() & ~F.isnan(big)
    trace = F.when(usable, F.col("n") * -1 * (F.ln(1 - big) + F.ln(1 - F.greatest(small, F.lit(0.0)))))
    return m.select(*keys, "n", trace.alias("trace")).withColumn("p_value", chi2_8_tail(F.col("trace")))


def chi2_8_tail(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with 8 degrees of freedom, in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Adds ``rank`` and ``p_adjusted`` (step-up) within each family; a null p-value counts as 1."""
    df = df.withColumn("__p", F.coalesce(p, F.lit(1.0)))
    w = Window.partitionBy(*family).orderBy("__p", tie)
    df = df.withColumn("rank", F.row_number().over(w)).withColumn("__m", F.count("*").over(Window.partitionBy(*family)))
    back = Window.partitionBy(*family).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.min(F.col("__p") * F.col("__m") / F.col("rank")).over(back)
    return df.withColumn("p_adjusted", F.least(q, F.lit(1.0))).drop("__p", "__m")


def ticker_cap(pairs: DataFrame, family: str, order: list[str], cap: int) -> DataFrame:
    """Greedy selection in order: a pair is kept while neither of its tickers has ``cap`` kept pairs already.

    Sequential by nature, so one group per family; families are short lists of candidate pairs, ranked before."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        keep = []
        for a, b in zip(pdf["ticker_a"], pdf["ticker_b"]):
            ok = used.get(a, 0) < cap and used.get(b, 0) < cap
            keep.append(ok)
            if ok:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        return pdf[keep]

    return pairs.groupBy(family).applyInPandas(lambda pdf: pick(pdf.sort_values(order, kind="stable")), pairs.schema)
