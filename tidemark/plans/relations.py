"""Queries on joins, aggregations, sets, pairs and kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import gates as G
from tidemark.operators import kernels as K
from tidemark.operators import pairs as P
from tidemark.operators import windows as W
from tidemark.operators.asof import asof_backward, asof_many
from tidemark.plans.registry import Registry
from tidemark.plans.series import BARS, r6, returns
from tidemark.sources.market import daily_panel, event_ticks, hourly_bars
from tidemark.sources.scratch import materialise
from tidemark.sources.tables import broadcast_if_small, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Aligned pairs of hourly log closes, and of the spread of each by least squares.
PAIRS = BARS + """, pairs AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, a.ts, ln(a.close) AS a, ln(b.close) AS b FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker < b.ticker),
stats AS (SELECT ticker_a, ticker_b, count(*) AS n, regr_slope(a, b) AS beta, regr_intercept(a, b) AS alpha, corr(a, b) AS rho, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab, avg(a) AS ma, avg(b) AS mb FROM pairs GROUP BY 1, 2),
spreads AS (SELECT p.*, p.a - s.alpha - s.beta * p.b AS spread FROM pairs p JOIN stats s USING (ticker_a, ticker_b)),
zs AS (SELECT *, CASE WHEN count(spread) OVER w >= 12 THEN (spread - avg(spread) OVER w) / greatest(stddev_samp(spread) OVER w, 1e-10) END AS z,
  row_number() OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts) AS i FROM spreads WINDOW w AS (PARTITION BY ticker_a, ticker_b ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
"""
PAIR = ["ticker_a", "ticker_b"]


def log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of hourly log closes."""
    panel = materialise(hourly_bars(spark, sf_dir).select("ticker", "ts", F.ln("close").alias("value")), "panel")
    return P.aligned_pairs(panel)  # the panel is read for either leg, and again wherever pairs meet their statistics


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-squares spread of every pair and its rolling z-score ``z``."""
    pairs = log_pairs(spark, sf_dir)
    stats = P.pair_statistics(pairs, PAIR).select(*PAIR, "alpha_ols", "beta_ols")
    s = pairs.join(stats, PAIR).withColumn("spread", F.col("a") - F.col("alpha_ols") - F.col("beta_ols") * F.col("b"))
    return s.withColumn("z", W.zscore(F.col("spread"), W.over(PAIR, ["ts"], (-23, 0)), 12)).drop("alpha_ols", "beta_ols")


@query(PAIRS + """SELECT ticker_a, ticker_b, n, round(n / (SELECT max(c) FROM (SELECT count(*) AS c FROM bars GROUP BY ticker)), 6) AS overlap FROM stats""")
def pairs_overlap(spark, sf_dir):
    """Aligned rows of every pair, as a share of the longest series."""
    bars = hourly_bars(spark, sf_dir)
    most = bars.groupBy("ticker").count().agg(F.max("count").alias("most"))
    n = log_pairs(spark, sf_dir).groupBy(*PAIR).agg(F.count("*").alias("n")).join(F.broadcast(most))
    return n.select(*PAIR, "n", F.round(F.col("n") / F.col("most"), 6).alias("overlap"))


@query(BARS + "SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)")
def complete_cases(spark, sf_dir):
    """Times at which every ticker has a bar."""
    bars = hourly_bars(spark, sf_dir)
    all_of = bars.agg(F.count_distinct("ticker").alias("all"))
    return bars.groupBy("ts").agg(F.count_distinct("ticker").alias("n")).join(F.broadcast(all_of)).where(F.col("n") == F.col("all")).select("ts")


@query(PAIRS + "SELECT ticker_a, ticker_b, n, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(rho, 6) AS rho FROM stats")
def ols_hedge(spark, sf_dir):
    """Least-squares hedge ratio of every pair."""
    s = P.pair_statistics(log_pairs(spark, sf_dir), PAIR)
    return s.select(*PAIR, "n", F.round("beta_ols", 6).alias("beta"), F.round("alpha_ols", 6).alias("alpha"), F.round("corr", 6).alias("rho"))


@query(PAIRS + """, e AS (SELECT *, (va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + cab * cab) AS least FROM stats), h AS (SELECT *, CASE WHEN abs(cab) > 1e-12 THEN (va - least) / cab END AS b FROM e)
SELECT ticker_a, ticker_b, round(b, 4) AS beta, round(va - 2 * b * cab + b * b * vb, 4) AS noise FROM h WHERE abs(b) <= 50""")
def pca_hedge(spark, sf_dir):
    """Principal-component hedge ratio of every pair."""
    s = P.pair_statistics(log_pairs(spark, sf_dir), PAIR).where(F.abs("beta_pca") <= 50)
    return s.select(*PAIR, F.round("beta_pca", 4).alias("beta"), F.round("noise", 4).alias("noise"))


@query(PAIRS + """, l AS (SELECT ticker_a, ticker_b, lag(spread) OVER w AS l, spread - lag(spread) OVER w AS d FROM spreads WINDOW w AS (PARTITION BY ticker_a, ticker_b ORDER BY ts)),
k AS (SELECT ticker_a, ticker_b, count(d) AS n, regr_slope(d, l) AS kappa FROM l GROUP BY 1, 2)
SELECT ticker_a, ticker_b, n, round(CASE WHEN kappa < 0 THEN -ln(2) / kappa END, 6) AS half_life, CASE WHEN kappa < 0 THEN greatest(10, least(2000, CAST(round_even(-ln(2) / kappa, 0) AS INT))) ELSE 60 END AS window_len FROM k""")
def ou_half_life(spark, sf_dir):
    """Half-life of every spread, and the window length that follows from it."""
    h = P.half_life(spreads(spark, sf_dir), PAIR, "ts")
    length = F.coalesce(F.greatest(F.lit(10), F.least(F.lit(2000), F.bround("half_life").cast("int"))), F.lit(60))
    return h.select(*PAIR, "n", F.round("half_life", 6).alias("half_life"), length.alias("window_len"))


@query(PAIRS + """, c AS (SELECT ticker_a, ticker_b, ts, sign(spread - avg(spread) OVER (PARTITION BY ticker_a, ticker_b)) AS s FROM spreads),
n AS (SELECT *, lag(s) OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts) AS p FROM c WHERE s <> 0) SELECT ticker_a, ticker_b, count(*) FILTER (WHERE s <> p) AS crossings FROM n GROUP BY 1, 2""")
def zero_crossings(spark, sf_dir):
    """Sign changes of every demeaned spread, zeros left aside."""
    s = spreads(spark, sf_dir).withColumn("s", F.signum(F.col("spread") - F.avg("spread").over(Window.partitionBy(*PAIR)))).where("s <> 0")
    s = s.withColumn("p", F.lag("s").over(W.over(PAIR, ["ts"])))
    return s.groupBy(*PAIR).agg(F.count_if(F.col("s") != F.col("p")).alias("crossings"))


@query(PAIRS + """, r AS (SELECT *, a - lag(a) OVER w AS ra, b - lag(b) OVER w AS rb, date_diff('second', lag(ts) OVER w, ts) AS gap FROM pairs WINDOW w AS (PARTITION BY ticker_a, ticker_b ORDER BY ts))
SELECT ticker_a, ticker_b, round(corr(ra, rb), 6) AS rho FROM r WHERE gap <= 7200 GROUP BY 1, 2 HAVING corr(ra, rb) >= -0.05""")
def corr_floor(spark, sf_dir):
    """Pairs whose returns, gaps left aside, are correlated enough."""
    w, p = W.over(PAIR, ["ts"]), log_pairs(spark, sf_dir)
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    r = p.select(*PAIR, (F.col("a") - F.lag("a").over(w)).alias("ra"), (F.col("b") - F.lag("b").over(w)).alias("rb"), (sec - F.lag(sec).over(w)).alias("gap"))
    return r.where("gap <= 7200").groupBy(*PAIR).agg(W.correlation("ra", "rb").alias("raw")).where("raw >= -0.05").select(*PAIR, F.round("raw", 6).alias("rho"))


@query()
def johansen_trace(spark, sf_dir):
    """Johansen trace statistic of every pair with its p-value and Benjamini-Hochberg adjustment."""
    t = P.johansen_trace(log_pairs(spark, sf_dir), PAIR).withColumns({"family": F.lit(1), "pair": F.concat_ws("_", *PAIR)})
    return P.benjamini_hochberg(t, ["family"], "p_value", "pair").drop("family", "pair")


@query("""WITH p AS (SELECT fold, upper(trim(pair_id)) AS pair, min(johansen_pval) AS p FROM pair_list GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY fold) AS m FROM p WINDOW w AS (PARTITION BY fold ORDER BY coalesce(p, 1), pair))
SELECT fold, pair, rank, round(least(1, min(coalesce(p, 1) * m / rank) OVER (PARTITION BY fold ORDER BY rank DESC)), 9) AS p_adjusted FROM r""")
def bh_fdr(spark, sf_dir):
    """Benjamini-Hochberg adjusted p-values of the listed pairs per fold."""
    p = table(spark, sf_dir, "pair_list").groupBy("fold", F.upper(F.trim("pair_id")).alias("pair")).agg(F.min("johansen_pval").alias("p"))
    q = P.benjamini_hochberg(p, ["fold"], "p", "pair")
    return q.select("fold", "pair", "rank", F.round("p_adjusted", 9).alias("p_adjusted"))


@query("""WITH p AS (SELECT DISTINCT fold, upper(trim(pair_id)) AS pair, johansen_pval AS p FROM pair_list)
SELECT fold, pair, p FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p, pair) AS k FROM p) WHERE k <= 5""")
def topk_pairs(spark, sf_dir):
    """The five pairs of least p-value of every fold."""
    p = table(spark, sf_dir, "pair_list").select("fold", F.upper(F.trim("pair_id")).alias("pair"), F.col("johansen_pval").alias("p")).distinct()
    return p.withColumn("k", F.row_number().over(W.over(["fold"], ["p", "pair"]))).where("k <= 5").drop("k")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT fold, ticker_a, ticker_b, johansen_pval FROM pair_list),
n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY johansen_pval NULLS LAST, ticker_a, ticker_b) AS k FROM p),
walk AS (SELECT fold, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS ticker_a, CAST(NULL AS VARCHAR) AS ticker_b, CAST(NULL AS DOUBLE) AS johansen_pval, false AS kept FROM (SELECT DISTINCT fold FROM p)
  UNION ALL SELECT w.fold, n.k, CASE WHEN len(list_filter(w.used, lambda x: x = n.ticker_a)) < 2 AND len(list_filter(w.used, lambda x: x = n.ticker_b)) < 2 THEN w.used || [n.ticker_a, n.ticker_b] ELSE w.used END, n.ticker_a, n.ticker_b, n.johansen_pval,
    len(list_filter(w.used, lambda x: x = n.ticker_a)) < 2 AND len(list_filter(w.used, lambda x: x = n.ticker_b)) < 2 FROM walk w JOIN n ON n.fold = w.fold AND n.k = w.k + 1)
SELECT fold, ticker_a, ticker_b, johansen_pval FROM walk WHERE kept""")
def ticker_cap(spark, sf_dir):
    """Greedy choice of each fold's pairs in order of p-value, a ticker at most twice."""
    p = table(spark, sf_dir, "pair_list").select("fold", "ticker_a", "ticker_b", "johansen_pval").distinct()
    return P.ticker_cap(p, "fold", ["johansen_pval", "ticker_a", "ticker_b"], 2)


@query(PAIRS.replace("WITH ticks", "WITH RECURSIVE ticks", 1) + """, walk AS (
  SELECT ticker_a, ticker_b, i, ts, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS position FROM zs WHERE i = 1
  UNION ALL SELECT n.ticker_a, n.ticker_b, n.i, n.ts, CASE WHEN n.z IS NULL THEN w.position WHEN w.position = 1 THEN CASE WHEN n.z >= -0.2 THEN 0 ELSE 1 END
    WHEN w.position = -1 THEN CASE WHEN n.z <= 0.2 THEN 0 ELSE -1 END WHEN n.z < -1.5 THEN 1 WHEN n.z > 1.5 THEN -1 ELSE 0 END
  FROM walk w JOIN zs n ON n.ticker_a = w.ticker_a AND n.ticker_b = w.ticker_b AND n.i = w.i + 1)
SELECT ticker_a, ticker_b, ts, CAST(position AS BIGINT) AS position FROM walk""")
def state_machine(spark, sf_dir):
    """Positions of every pair by the entry and exit rules on its z-score."""
    return K.with_positions(spreads(spark, sf_dir), PAIR, ["ts"], "z", 1.5, 0.2).select(*PAIR, "ts", "position")


@query(PAIRS.replace("WITH ticks", "WITH RECURSIVE ticks", 1) + """, walk AS (
  SELECT ticker_a, ticker_b, i, ts, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS position, 0 AS code FROM zs WHERE i = 1
  UNION ALL SELECT n.ticker_a, n.ticker_b, n.i, n.ts,
    CASE WHEN n.z IS NULL THEN w.position WHEN w.position = 1 AND (n.z <= -2.5 OR n.z >= -0.2) THEN 0 WHEN w.position = -1 AND (n.z >= 2.5 OR n.z <= 0.2) THEN 0
      WHEN w.position <> 0 THEN w.position WHEN n.z < -1.5 THEN 1 WHEN n.z > 1.5 THEN -1 ELSE 0 END,
    CASE WHEN n.z IS NULL THEN 0 WHEN w.position = 1 AND n.z <= -2.5 OR w.position = -1 AND n.z >= 2.5 THEN 2 WHEN w.position = 1 AND n.z >= -0.2 OR w.position = -1 AND n.z <= 0.2 THEN 1 ELSE 0 END
  FROM walk w JOIN zs n ON n.ticker_a = w.ticker_a AND n.ticker_b = w.ticker_b AND n.i = w.i + 1)
SELECT ticker_a, ticker_b, code AS exit_code, count(*) AS bars, sum(abs(position)) AS held FROM walk GROUP BY 1, 2, 3""")
def state_machine_stop(spark, sf_dir):
    """Bars by exit code, with a hard stop looked at before the exit."""
    p = K.with_positions(spreads(spark, sf_dir), PAIR, ["ts"], "z", 1.5, 0.2, 2.5)
    return p.groupBy(*PAIR, "exit_code").agg(F.count("*").alias("bars"), F.sum(F.abs("position")).alias("held"))


@query(PAIRS.replace("WITH ticks", "WITH RECURSIVE ticks", 1) + """, walk AS (
  SELECT ticker_a, ticker_b, i, ts, spread, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS position FROM zs WHERE i = 1
  UNION ALL SELECT n.ticker_a, n.ticker_b, n.i, n.ts, n.spread, CASE WHEN n.z IS NULL THEN w.position WHEN w.position = 1 THEN CASE WHEN n.z >= -0.2 THEN 0 ELSE 1 END
    WHEN w.position = -1 THEN CASE WHEN n.z <= 0.2 THEN 0 ELSE -1 END WHEN n.z < -1.5 THEN 1 WHEN n.z > 1.5 THEN -1 ELSE 0 END
  FROM walk w JOIN zs n ON n.ticker_a = w.ticker_a AND n.ticker_b = w.ticker_b AND n.i = w.i + 1),
l AS (SELECT w.*, k.k, lag(position, k.k, 0) OVER (PARTITION BY ticker_a, ticker_b, k.k ORDER BY ts) AS held, spread - lag(spread) OVER (PARTITION BY ticker_a, ticker_b, k.k ORDER BY ts) AS move FROM walk w CROSS JOIN (SELECT unnest([1, 2, 5]) AS k) k)
SELECT ticker_a, ticker_b, CAST(k AS INT) AS exec_lag, round(sum(held * move), 6) AS gross FROM l GROUP BY 1, 2, 3""")
def exec_lag_sweep(spark, sf_dir):
    """Gross result of every pair when signals are carried out one, two or five bars later."""
    p = K.with_positions(spreads(spark, sf_dir), PAIR, ["ts"], "z", 1.5, 0.2)
    w = W.over(PAIR, ["ts"])
    p = p.withColumn("move", F.col("spread") - F.lag("spread").over(w))
    p = p.select(*PAIR, "move", *[F.lag("position", k, 0).over(w).alias(f"held_{k}") for k in (1, 2, 5)])
    p = p.select(*PAIR, "move", F.explode(F.array(*[F.struct(F.lit(k).alias("exec_lag"), F.col(f"held_{k}").alias("held")) for k in (1, 2, 5)])).alias("x"))
    return p.groupBy(*PAIR, "x.exec_lag").agg(F.round(F.sum(F.col("x.held") * F.col("move")), 6).alias("gross"))


@query(PAIRS.replace("WITH ticks", "WITH RECURSIVE ticks", 1) + """, walk AS (
  SELECT ticker_a, ticker_b, i, ts, spread, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS position FROM zs WHERE i = 1
  UNION ALL SELECT n.ticker_a, n.ticker_b, n.i, n.ts, n.spread, CASE WHEN n.z IS NULL THEN w.position WHEN w.position = 1 THEN CASE WHEN n.z >= -0.2 THEN 0 ELSE 1 END
    WHEN w.position = -1 THEN CASE WHEN n.z <= 0.2 THEN 0 ELSE -1 END WHEN n.z < -1.5 THEN 1 WHEN n.z > 1.5 THEN -1 ELSE 0 END
  FROM walk w JOIN zs n ON n.ticker_a = w.ticker_a AND n.ticker_b = w.ticker_b AND n.i = w.i + 1),
e AS (SELECT *, CASE WHEN position <> 0 AND position <> coalesce(lag(position) OVER w, 0) THEN 1 ELSE 0 END AS entered FROM walk WINDOW w AS (PARTITION BY ticker_a, ticker_b ORDER BY ts)),
t AS (SELECT *, sum(entered) OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts) AS trade FROM e)
SELECT ticker_a, ticker_b, trade, min(position) AS side, min(ts) AS entry_ts, max(ts) AS exit_ts, count(*) AS bars, round(min(position) * (last(spread ORDER BY ts) - first(spread ORDER BY ts)), 6) AS result FROM t WHERE position <> 0 GROUP BY 1, 2, 3""")
def trade_log(spark, sf_dir):
    """The trades of every pair: entry and exit are matched by the running count of entries."""
    p = K.trades(K.with_positions(spreads(spark, sf_dir), PAIR, ["ts"], "z", 1.5, 0.2), PAIR, ["ts"]).where("trade is not null")
    return p.groupBy(*PAIR, "trade").agg(
        F.min("position").alias("side"), F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.count("*").alias("bars"),
        F.round(F.min("position") * (F.max_by("spread", "ts") - F.min_by("spread", "ts")), 6).alias("result"),
    )


#: The two-state filter, a bar a step; the covariance is carried in its three numbers.
_FILTER = PAIRS.replace("WITH ticks", "WITH RECURSIVE ticks", 1) + """, bars_of AS (SELECT ticker_a, ticker_b, ts, a, b, row_number() OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts) AS i FROM pairs),
filter AS (SELECT ticker_a, ticker_b, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS spread, 0.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta, 1e-2::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1e-2::DOUBLE AS p11 FROM (SELECT DISTINCT ticker_a, ticker_b FROM pairs)
  UNION ALL SELECT ticker_a, ticker_b, i, ts, miss, alpha + k0 * miss, beta + k1 * miss,
    (1 - k0) * ((1 - k0) * p00 - k0 * x * p01) - k0 * x * ((1 - k0) * p01 - k0 * x * p11) + k0 * k0 * 1e-2,
    -k1 * ((1 - k0) * p00 - k0 * x * p01) + (1 - k1 * x) * ((1 - k0) * p01 - k0 * x * p11) + k0 * k1 * 1e-2,
    -k1 * (-k1 * p00 + (1 - k1 * x) * p01) + (1 - k1 * x) * (-k1 * p01 + (1 - k1 * x) * p11) + k1 * k1 * 1e-2
  FROM (SELECT *, (p00 + p01 * x) / s AS k0, (p01 + p11 * x) / s AS k1 FROM (SELECT *, p00 + 2 * p01 * x + p11 * x * x + 1e-2 AS s FROM (
    SELECT n.ticker_a, n.ticker_b, n.i, n.ts, n.b AS x, n.a - f.alpha - f.beta * n.b AS miss, f.alpha, f.beta, f.p00 + 1e-6 AS p00, f.p01, f.p11 + 1e-6 AS p11
    FROM filter f JOIN bars_of n ON n.ticker_a = f.ticker_a AND n.ticker_b = f.ticker_b AND n.i = f.i + 1))))
"""


@query(_FILTER + "SELECT ticker_a, ticker_b, ts, round(spread, 6) AS spread, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM filter WHERE i > 0")
def kalman_spread(spark, sf_dir):
    """Filtered hedge ratio and spread of every pair."""
    k = K.with_kalman(log_pairs(spark, sf_dir), PAIR, ["ts"], "a", "b", 1e-4, 1e-2)
    return k.select(*PAIR, "ts", *r6("spread", "alpha", "beta"))


@query()
def rebalance_events(spark, sf_dir):
    """Bars on which the guarded filter's hedge ratio leaves its band while a position is held."""
    p = K.with_positions(spreads(spark, sf_dir), PAIR, ["ts"], "z", 1.5, 0.2).drop("spread")
    k = K.with_kalman(p, PAIR, ["ts"], "a", "b", 1e-4, 1e-2, gate=4.0, clamp=(-5.0, 5.0))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(rebalance=K.rebalances(pdf["beta"].to_numpy(float), pdf["position"].to_numpy(), 0.005))

    return K.per_series(k, PAIR, ["ts"], kernel, "rebalance boolean").where("rebalance").select(*PAIR, "ts", "position", F.round("beta", 6).alias("beta"))


@query()
def change_points(spark, sf_dir):
    """Change points of every ticker's daily close and volume by kernel segmentation."""
    d = hourly_bars(spark, sf_dir).groupBy("ticker", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day", ignore_index=True)
        x = pdf[["close", "volume"]].to_numpy(float)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        at = K.change_points(x, 1.0, 2)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[:1].repeat(len(at)), "day": pdf["day"].iloc[at].to_numpy()})

    return d.groupBy("ticker").applyInPandas(find, "ticker string, day date")


def complete_returns(panel: DataFrame) -> tuple[DataFrame, int]:
    """(ticker, ts, x, r, c) of the tickers with a positive value at every time of a panel, and the number of its times:
    log values, their changes, and these less their ticker's mean. Written once, as all that follows reads it again."""
    p = panel.where("value > 0 and not isnan(value)").select("ticker", "ts", F.ln("value").alias("x"))
    n = panel.select("ts").distinct().count()
    p = p.join(p.groupBy("ticker").count().where(F.col("count") == n).select("ticker"), "ticker", "left_semi")
    p = p.withColumn("r", F.col("x") - F.lag("x").over(W.over(["ticker"], ["ts"])))
    return materialise(p.withColumn("c", F.col("r") - F.avg("r").over(Window.partitionBy("ticker"))), "returns"), n


def factor_loadings(complete: DataFrame, n: int, components: int, least_tickers: int, least_rows: int) -> tuple[DataFrame, float | None]:
    """(ticker, w) of the tickers of ``complete_returns``, ``w`` their loadings on the leading principal components of
    centred log returns, and the components' share of the variance. Below the minimums there are no rows.

    The products of returns are summed in Spark, over the tickers if these outnumber the times, else over the times; the
    driver solves a matrix whose side is the smaller of the two numbers. In the first case its vectors are weights of
    times, from which Spark sums each ticker's loadings; a component beyond the returns' rank has none."""
    spark = complete.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in complete.schema}
    none = spark.createDataFrame([], f"ticker {kinds['ticker']}, w array<double>")
    c = complete.where("c is not null and ts is not null").select("ticker", "ts", "c")
    tickers = c.select("ticker").distinct().count()
    if tickers < max(least_tickers, components) or n < least_rows:
        return none, None
    side, other = ("ts", "ticker") if n - 1 < tickers else ("ticker", "ts")
    names = [x[0] for x in c.select(side).distinct().orderBy(side).collect()]
    vector = F.transform(F.array_sort(F.collect_list(F.struct(side, "c"))), lambda x: x["c"])
    m = K.products(c.groupBy(other).agg(vector.alias("v")).select("v"))
    v = K.principal_residuals(m, min(components, len(names)))
    held = np.einsum("ki,ij,kj->k", v, m, v)
    explained = float(held.sum() / np.trace(m)) if np.trace(m) > 0 else None
    if side == "ts":
        real = held > len(names) * np.finfo(float).eps * held.max()
        v = v * np.where(real, 1 / np.sqrt(np.where(real, held, 1.0)), 0.0)[:, None]
        v = np.vstack([v, np.zeros((components - len(v), len(names)))])
    rows = F.broadcast(spark.createDataFrame([(t, v[:, k].tolist()) for k, t in enumerate(names)], f"`{side}` {kinds[side]}, w array<double>"))
    if side == "ticker":
        return rows, explained
    w = c.join(rows, "ts").groupBy("ticker").agg(F.array(*[F.sum(F.col("w")[k] * F.col("c")) for k in range(components)]).alias("w"))
    return broadcast_if_small(materialise(w, "loadings")), explained


def residual_prices(panel: DataFrame, components: int = 5, least_tickers: int = 50, least_rows: int = 200) -> DataFrame:
    """(ticker, ts, residual, residual_log_price, explained) of a panel (ticker, ts, value) after its leading principal
    components (see ``factor_loadings``).

    The projection takes the returns as they are. The residuals are summed from the first log price, whose row has no
    residual; ``explained`` is the components' share of the variance.
    """
    w = W.over(["ticker"], ["ts"])
    complete, n = complete_returns(panel)
    loadings, explained = factor_loadings(complete, n, components, least_tickers, least_rows)
    l = complete.join(loadings, "ticker")
    f = l.where("r is not null").groupBy("ts").agg(F.array(*[F.sum(F.col("w")[k] * F.col("r")) for k in range(components)]).alias("f"))
    held = sum((F.col("w")[k] * F.col("f")[k] for k in range(1, components)), F.col("w")[0] * F.col("f")[0])
    out = l.join(f, "ts", "left").withColumn("residual", F.col("r") - held)
    price = F.first("x").over(w) + F.coalesce(F.sum("residual").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return out.select("ticker", "ts", F.round("residual", 6).alias("residual"), F.round(price, 6).alias("residual_log_price"), F.round(F.lit(explained).cast("double"), 6).alias("explained"))


@query()
def factor_residuals(spark, sf_dir):
    """Residual log returns and prices of the users' daily panel after its five leading principal components.

    The minimums are those that five components need, as the events span 30 days.
    """
    return residual_prices(daily_panel(spark, sf_dir), 5, 6, 7)


@query(BARS + """, r AS (SELECT ticker, ts, ln(value / lag(value) OVER (PARTITION BY ticker ORDER BY ts)) AS r FROM (SELECT event_type AS ticker, CAST(ts AS DATE) AS ts, last(price ORDER BY ts, event_id) AS value FROM (SELECT event_id, ticker AS event_type, ts, price FROM ticks) GROUP BY 1, 2)),
p AS (SELECT a.ticker AS i, b.ticker AS j, a.ts, corr(a.r, b.r) OVER w AS c, count(a.r * b.r) OVER w AS n FROM r a JOIN r b ON a.ts = b.ts AND a.ticker < b.ticker WINDOW w AS (PARTITION BY a.ticker, b.ticker ORDER BY a.ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT ts, round(avg(c), 6) AS mean_corr, count(*) AS pairs FROM p WHERE n >= 8 GROUP BY ts""")
def pairwise_rolling_corr(spark, sf_dir):
    """Mean of all pairs' rolling correlations of daily returns, by the ten days before."""
    p = daily_panel(spark, sf_dir, "ticker").withColumn("value", F.ln(F.col("value") / F.lag("value").over(W.over(["ticker"], ["ts"]))))
    w = W.over(PAIR, ["ts"], (-10, -1))
    # a pair keeps the row of its first day, which has no return: it takes up a frame slot
    a = p.select(F.col("ticker").alias("ticker_a"), "ts", F.col("value").alias("a"))
    b = p.select(F.col("ticker").alias("ticker_b"), "ts", F.col("value").alias("b"))
    c = a.join(b, "ts").where("ticker_a < ticker_b").select("ts", W.correlation("a", "b", w).alias("c"), F.count(F.col("a") * F.col("b")).over(w).alias("n"))
    return c.where("n >= 8").groupBy("ts").agg(F.round(F.avg("c"), 6).alias("mean_corr"), F.count("*").alias("pairs"))


@query(BARS + """, x AS (SELECT CAST(ts AS DATE) AS day, avg(r) AS m, stddev_samp(r) AS s FROM rets GROUP BY 1)
SELECT day, round(avg(m) OVER w, 6) AS mean_5, round(stddev_samp(m) OVER w, 6) AS vol_5, round(avg(s) OVER w, 6) AS dispersion_5 FROM x WINDOW w AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def cross_section(spark, sf_dir):
    """Cross-sectional mean and dispersion by day, then rolling. The window runs over one row per day."""
    x = returns(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    w = Window.orderBy("day").rowsBetween(-4, 0)
    return x.select("day", F.round(F.avg("m").over(w), 6).alias("mean_5"), F.round(F.stddev_samp("m").over(w), 6).alias("vol_5"), F.round(F.avg("s").over(w), 6).alias("dispersion_5"))


@query(BARS + """SELECT o.order_no, o.ticker, b.close AS spread FROM (SELECT o_orderkey AS order_no, CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'absent' END AS ticker,
TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((o_orderkey * 7919) % 2600000) AS at FROM orders) o ASOF LEFT JOIN bars b ON b.ticker = o.ticker AND b.ts <= o.at""")
def asof_lookup(spark, sf_dir):
    """The last bar at or before each probe's time."""
    k = F.col("o_orderkey")
    names = F.when(k % 5 == 0, "click").when(k % 5 == 1, "view").when(k % 5 == 2, "purchase").when(k % 5 == 3, "error").otherwise("absent")
    at = F.timestamp_seconds(F.lit(1704067200) + (k * 7919) % 2600000).cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select(k.alias("order_no"), names.alias("ticker"), at.alias("at"))
    got = asof_backward(o, hourly_bars(spark, sf_dir).select("ticker", F.col("ts").alias("at"), F.col("close").alias("spread")), "ticker", "at", ["spread"])
    return got.select("order_no", "ticker", "spread")


@query(BARS + """, o AS (SELECT o_orderkey AS k, 'click' AS a, 'view' AS b, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((o_orderkey * 7919) % 2600000) AS t0, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((o_orderkey * 7919) % 2600000 + 7200) AS t1 FROM orders)
SELECT o.k AS order_no, coalesce(a0.close, 30) AS a_entry, coalesce(a1.close, 30) AS a_exit, coalesce(b0.close, 30) AS b_entry, coalesce(b1.close, 30) AS b_exit FROM o
ASOF LEFT JOIN bars a0 ON a0.ticker = o.a AND a0.ts <= o.t0 ASOF LEFT JOIN bars a1 ON a1.ticker = o.a AND a1.ts <= o.t1
ASOF LEFT JOIN bars b0 ON b0.ticker = o.b AND b0.ts <= o.t0 ASOF LEFT JOIN bars b1 ON b1.ticker = o.b AND b1.ts <= o.t1""")
def asof_four_way(spark, sf_dir):
    """Four as-of lookups per trade (two legs at entry and exit) in one pass, with a fallback."""
    s = (F.col("o_orderkey") * 7919) % 2600000
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_no"), F.lit("click").alias("a"), F.lit("view").alias("b"),
        F.timestamp_seconds(F.lit(1704067200) + s).cast("timestamp_ntz").alias("t0"), F.timestamp_seconds(F.lit(1704067200) + s + 7200).cast("timestamp_ntz").alias("t1"),
    )
    probes = {"a_entry": ("a", "t0"), "a_exit": ("a", "t1"), "b_entry": ("b", "t0"), "b_exit": ("b", "t1")}
    bars = hourly_bars(spark, sf_dir).select("ticker", "ts", "close")
    return asof_many(o, bars, probes, ["order_no"], "close", right_key="ticker", right_at="ts", fallback={"close": 30.0})


@query("""WITH f AS (SELECT i AS fold, DATE '1996-01-01' + CAST(i * 91 AS INT) AS a, DATE '1996-01-01' + CAST(i * 91 + 180 AS INT) AS b FROM (SELECT unnest(generate_series(0, 9)) AS i))
SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN f ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY 1""")
def fold_range_join(spark, sf_dir):
    """Rows of every overlapping fold of a walk-forward schedule."""
    base = F.lit("1996-01-01").cast("date")
    folds = spark.range(10).select(F.col("id").cast("int").alias("fold"), F.date_add(base, (F.col("id") * 91).cast("int")).alias("start"), F.date_add(base, (F.col("id") * 91 + 180).cast("int")).alias("end"))
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return B.in_folds(o, "day", folds).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(BARS + """, g AS (SELECT t.ticker, b.b AS bucket FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT unnest(generate_series(0, 11)) AS b) b),
s AS (SELECT ticker, hour(ts) // 2 AS bucket, avg(close) AS mean, median(close) AS med, quantile_cont(close, 0.95) AS p95, count(*) AS n FROM bars GROUP BY 1, 2)
SELECT g.ticker, CAST(g.bucket AS INT) AS bucket, round(mean, 6) AS mean, round(med, 6) AS med, round(p95, 6) AS p95, coalesce(n, 0) AS n FROM g LEFT JOIN s ON s.ticker = g.ticker AND s.bucket = g.bucket""")
def seasonality(spark, sf_dir):
    """Mean, median and 95 % quantile by two-hour bucket, all buckets given."""
    b = hourly_bars(spark, sf_dir)
    s = b.groupBy("ticker", (F.hour("ts") / 2).cast("int").alias("bucket")).agg(
        F.round(F.avg("close"), 6).alias("mean"), F.round(F.median("close"), 6).alias("med"), F.round(F.percentile("close", 0.95), 6).alias("p95"), F.count("*").alias("n")
    )
    grid = b.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("bucket"))
    return grid.join(s, ["ticker", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT l_shipmode_like AS mode, year AS y, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM (SELECT l_returnflag AS l_shipmode_like, year(l_shipdate) AS year, l_quantity FROM lineitem) GROUP BY ROLLUP (1, 2)""")
def waterfall_rollup(spark, sf_dir):
    """Sums by flag and year with subtotals and the overall total."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.year("l_shipdate").alias("y"), "l_quantity")
    return l.rollup("mode", "y").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT month(o_orderdate) AS m, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1""")
def pivot_means(spark, sf_dir):
    """Means by month, statuses as columns."""
    o = table(spark, sf_dir, "orders").withColumn("m", F.month("o_orderdate"))
    return o.groupBy("m").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("""WITH v AS (SELECT l_suppkey, sum(l_quantity) AS adv FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(adv, 1.0 / 3) AS a, quantile_cont(adv, 2.0 / 3) AS b FROM v)
SELECT l_suppkey, adv, CASE WHEN adv <= a THEN 'T1' WHEN adv <= b THEN 'T2' ELSE 'T3' END AS tier FROM v, q""")
def adv_tertiles(spark, sf_dir):
    """Suppliers by tertile of volume, cut at interpolated quantiles."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("adv"))
    q = G.exact_quantiles(v.select(F.lit(1).alias("all"), F.col("adv").cast("double").alias("v")), "all", "v", [1 / 3, 2 / 3]).select(F.col("quantiles").alias("q"))
    tier = F.when(F.col("adv") <= F.col("q")[0], "T1").when(F.col("adv") <= F.col("q")[1], "T2").otherwise("T3")
    return v.join(F.broadcast(q)).select("l_suppkey", "adv", tier.alias("tier"))


@query("""WITH r AS (SELECT unnest(['hard_sl', 'zero_cross', 'kill_switch', 'time_stop', 'never']) AS exit_reason), c AS (SELECT exit_reason, count(*) AS n, round(avg(realized_pnl), 6) AS mean, round(avg(CASE WHEN realized_pnl > 0 THEN 1.0 ELSE 0 END), 6) AS wins FROM trades_eow WHERE NOT isnan(realized_pnl) GROUP BY 1)
SELECT r.exit_reason, coalesce(n, 0) AS n, mean, wins FROM r LEFT JOIN c USING (exit_reason)""")
def exit_breakdown(spark, sf_dir):
    """Trades by exit reason, reasons without trades included."""
    r = spark.createDataFrame([(x,) for x in ("hard_sl", "zero_cross", "kill_switch", "time_stop", "never")], "exit_reason string")
    t = table(spark, sf_dir, "trades_eow").where("realized_pnl is not null and not isnan(realized_pnl)").groupBy("exit_reason").agg(
        F.count("*").alias("n"), F.round(F.avg("realized_pnl"), 6).alias("mean"), F.round(F.avg((F.col("realized_pnl") > 0).cast("double")), 6).alias("wins")
    )
    return r.join(t, "exit_reason", "left").select("exit_reason", F.coalesce("n", F.lit(0)).alias("n"), "mean", "wins")


@query("""WITH d AS (SELECT trade_id, realized_pnl AS p, CAST(snapshot_ts AS DATE) AS day FROM trades_eow WHERE NOT isnan(realized_pnl)), s AS (SELECT day, sum(p) AS pnl FROM d GROUP BY 1 HAVING sum(abs(p)) > 0)
SELECT count(*) AS days, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) AS sharpe, round(min(pnl), 4) AS worst, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM s""")
def sharpe_summary(spark, sf_dir):
    """Annualised ratio of mean to deviation of active days, worst day and share of winning days."""
    d = table(spark, sf_dir, "trades_eow").where("realized_pnl is not null and not isnan(realized_pnl)").groupBy(F.to_date("snapshot_ts").alias("day"))
    s = d.agg(F.sum("realized_pnl").alias("pnl"), F.sum(F.abs("realized_pnl")).alias("moved")).where("moved > 0")
    return s.agg(
        F.count("*").alias("days"), F.round(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * math.sqrt(252), 6).alias("sharpe"), F.round(F.min("pnl"), 4).alias("worst"),
        F.round(F.avg((F.col("pnl") > 0).cast("double")), 6).alias("win_rate"),
    )


@query("""WITH a AS (SELECT ticker, sum(fill_qty * CASE side WHEN 'buy' THEN 1 ELSE -1 END) AS qty FROM live_orders WHERE status = 'filled' AND NOT isnan(fill_qty) GROUP BY 1),
b AS (SELECT ticker, sum(qty * CASE side WHEN 'buy' THEN 1 ELSE -1 END) AS qty FROM live_orders WHERE status <> 'canceled' AND NOT isnan(qty) GROUP BY 1)
SELECT coalesce(a.ticker, b.ticker) AS ticker, a.qty AS filled, b.qty AS ordered FROM a FULL JOIN b ON a.ticker = b.ticker WHERE abs(coalesce(a.qty, 0) - coalesce(b.qty, 0)) > 1""")
def reconcile(spark, sf_dir):
    """Tickers whose filled and ordered quantities differ by more than one share."""
    o = table(spark, sf_dir, "live_orders")
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    a = o.where("status = 'filled' and fill_qty is not null and not isnan(fill_qty)").groupBy("ticker").agg(F.sum(F.col("fill_qty") * sign).alias("filled"))
    b = o.where("status <> 'canceled' and qty is not null and not isnan(qty)").groupBy("ticker").agg(F.sum(F.col("qty") * sign).alias("ordered"))
    return a.join(b, "ticker", "full").where(F.abs(F.coalesce("filled", F.lit(0.0)) - F.coalesce("ordered", F.lit(0.0))) > 1)


@query("""SELECT client_order_id, last(order_no ORDER BY order_no) AS order_no, last(status ORDER BY order_no) AS status, count(*) AS copies FROM live_orders GROUP BY 1""")
def latest_orders(spark, sf_dir):
    """The last row of every client order id."""
    o = table(spark, sf_dir, "live_orders").select("client_order_id", "order_no", "status")
    last = B.first_or_last(o, ["client_order_id"], ["order_no"])
    return last.join(o.groupBy("client_order_id").agg(F.count("*").alias("copies")), "client_order_id")


@query("""SELECT user_id FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS d FROM events GROUP BY 1) WHERE d >= 25
INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE value > 250""")
def set_operations(spark, sf_dir):
    """Users present on most days who bought something, without those of extreme values."""
    e = table(spark, sf_dir, "events")
    present = e.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("d")).where("d >= 25").select("user_id")
    return present.intersect(e.where("event_type = 'purchase'").select("user_id")).subtract(e.where("value > 250").select("user_id"))


@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id LIMIT 500")
def hash_sample(spark, sf_dir):
    """A reproducible sample of 500 rows by hashed key."""
    return table(spark, sf_dir, "events").select("event_id").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("-42"))), "event_id").limit(500)


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS large, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 2) AS large_sum, round(sum(value * CAST(json_extract(props, '$.k') AS DOUBLE)) / nullif(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 0), 6) AS weighted FROM events GROUP BY 1 HAVING count(*) >= 2""")
def conditional_aggregates(spark, sf_dir):
    """Counts and sums under conditions, exact distinct counts, a weighted mean."""
    t = event_ticks(spark, sf_dir)
    big = F.col("price") > 50
    return t.groupBy(F.col("ticker").alias("event_type")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(big).alias("large"),
        F.round(F.sum(F.when(big, F.col("price")).otherwise(0)), 2).alias("large_sum"),
        F.round(F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0.0)), 6).alias("weighted"),
    ).where("n >= 2")


@query("""SELECT count(*) AS n, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 8) AS r2,
round(regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS t FROM (SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem)""")
def impact_regression(spark, sf_dir):
    """Regression with the t-statistic of its slope, from sums alone."""
    l = table(spark, sf_dir, "lineitem").select(F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("x"))
    slope = W.slope("y", "x")
    rest = F.try_divide(F.regr_syy("y", "x") - slope * F.regr_sxy("y", "x"), F.count("*") - 2)
    return l.agg(
        F.count("*").alias("n"), F.round(slope, 8).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"),
        F.round(F.regr_r2("y", "x"), 8).alias("r2"), F.round(F.try_divide(slope, F.sqrt(F.try_divide(rest, F.regr_sxx("y", "x")))), 6).alias("t"),
    )


@query(BARS + """, d AS (SELECT ts AS day, avg(value) AS r, row_number() OVER (ORDER BY ts) - 1 AS i FROM daily GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
g AS (SELECT b.b, k.k, (b.b * 7919 + k.k * 104729 + b.b * k.k * 31) % n.n AS i FROM (SELECT unnest(generate_series(0, 199)) AS b) b, n, (SELECT unnest(generate_series(0, 400)) AS k) k WHERE k.k < n.n),
s AS (SELECT g.b, avg(d.r) / nullif(stddev_samp(d.r), 0) AS s FROM g JOIN d ON d.i = g.i GROUP BY 1)
SELECT count(s) AS draws, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi FROM s""")
def bootstrap(spark, sf_dir):
    """Mean-to-deviation ratio of 200 rearrangements of the days by a fixed linear rule, as its SQL has it.

    Not a bootstrap: a draw holds every day equally often or cycles through a few. See ``bootstrap_sharpe``.
    """
    d = daily_panel(spark, sf_dir).groupBy("ts").agg(F.avg("value").alias("r"))
    d = d.withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)  # a row per day
    n = d.count()
    b, k = F.col("b"), F.col("k")
    g = spark.range(200).withColumnRenamed("id", "b").select("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")) if n else spark.range(0).selectExpr("id as b", "0 as k")
    g = g.select("b", ((b * 7919 + k * 104729 + b * k * 31) % max(n, 1)).cast("int").alias("i"))
    s = g.join(F.broadcast(d.select("i", "r")), "i").groupBy("b").agg(F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("s"))
    return s.agg(F.count("s").alias("draws"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.percentile("s", 0.025), 6).alias("lo"), F.round(F.percentile("s", 0.975), 6).alias("hi"))


def bootstrap_draws(n: int, draws: int, seed: int, spark: SparkSession) -> DataFrame:
    """(b, i): ``n`` indices from 0 to n - 1 for each draw, by a hash of (seed, draw, position), so that they repeat."""
    g = spark.range(draws if n else 0).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("k"))
    return g.select("b", F.pmod(F.xxhash64(F.lit(seed), "b", "k"), F.lit(max(n, 1))).cast("int").alias("i"))


@query()
def bootstrap_sharpe(spark, sf_dir):
    """Bootstrap of the annual Sharpe ratio over days: 1,000 draws of days with replacement, the block one day.

    A draw without deviation counts as 0; fewer than two days give 0 in every draw.
    """
    d = daily_panel(spark, sf_dir).groupBy("ts").agg(F.avg("value").alias("r")).where("r is not null and not isnan(r)")
    d = d.withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)  # a row per day
    s = bootstrap_draws(d.count(), 1000, 42, spark).join(F.broadcast(d.select("i", "r")), "i").groupBy("b").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("dev"))
    s = spark.range(1000).withColumnRenamed("id", "b").join(s, "b", "left")
    s = s.select(F.when(F.col("dev") >= 1e-10, F.col("mean") / F.col("dev") * math.sqrt(252)).otherwise(0.0).alias("s"))
    return s.agg(F.count("s").alias("draws"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.percentile("s", 0.025), 6).alias("lo"), F.round(F.percentile("s", 0.975), 6).alias("hi"))


@query(BARS + """, m AS (SELECT ticker, avg(close) AS mu, stddev_pop(close) AS sd FROM bars GROUP BY 1), b AS (SELECT *, hash_bit FROM (SELECT *, (epoch(ts)::BIGINT // 3600) % 10 = 0 AS hash_bit FROM bars)),
x AS (SELECT b.ticker, b.ts, close, CASE WHEN hash_bit THEN coalesce(lead(close) OVER (PARTITION BY b.ticker ORDER BY b.ts), close) ELSE close END AS future, (close - mu) / sd AS normalised FROM b JOIN m ON m.ticker = b.ticker)
SELECT ticker, count(*) FILTER (WHERE future <> close) AS changed, round(sum(future), 4) AS future_sum, round(max(normalised), 6) AS top FROM x GROUP BY 1""")
def bias_injection(spark, sf_dir):
    """Planted look-ahead: every tenth hour takes the next close; full-sample normalisation beside it."""
    w, b = W.over(["ticker"], ["ts"]), hourly_bars(spark, sf_dir)
    picked = (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("bigint") % 10 == 0
    future = F.when(picked, F.coalesce(F.lead("close").over(w), "close")).otherwise(F.col("close"))
    m = b.groupBy("ticker").agg(F.avg("close").alias("mu"), F.stddev_pop("close").alias("sd"))
    x = b.withColumn("future", future).join(m, "ticker").withColumn("normalised", (F.col("close") - F.col("mu")) / F.col("sd"))
    return x.groupBy("ticker").agg(F.count_if(F.col("future") != F.col("close")).alias("changed"), F.round(F.sum("future"), 4).alias("future_sum"), F.round(F.max("normalised"), 6).alias("top"))
