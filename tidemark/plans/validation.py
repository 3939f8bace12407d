"""Queries that validate pairs, positions and results: block gates, changed positions, performance, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import kernels as K
from tidemark.operators import pairs as P
from tidemark.operators import windows as W
from tidemark.plans.registry import Registry
from tidemark.plans.relations import PAIR, bootstrap_draws, complete_returns, factor_loadings, log_pairs, spreads
from tidemark.plans.research import TRADE, WALK, holding, walked
from tidemark.plans.series import BARS, returns
from tidemark.sources.market import daily_panel, hourly_bars
from tidemark.sources.scratch import materialise
from tidemark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Where the month of events is cut into blocks.
CUTS = ("2024-01-11", "2024-01-21")


def _block(cuts: tuple[str, ...] = CUTS) -> Column:
    return sum(((F.col("ts") >= F.lit(c).cast("timestamp_ntz")).cast("int") for c in cuts), F.lit(1))


@query()
def temporal_gate(spark, sf_dir):
    """The first rule by which three blocks of time turn a pair down, else 'kept' (see ``G.temporal_gate``)."""
    return G.temporal_gate(log_pairs(spark, sf_dir).withColumn("block", _block()), PAIR, "ts", 3, bars_per_day=24)


@query()
def valid_gate(spark, sf_dir):
    """Whether a pair is cointegrated before the last cut and after it as well (see ``G.valid_gate``)."""
    return G.valid_gate(log_pairs(spark, sf_dir).withColumn("block", _block(CUTS[1:])), PAIR, "ts")


@query(WALK + """, l AS (SELECT *, row_number() OVER (PARTITION BY ticker_a, ticker_b, CAST(ts AS DATE) ORDER BY ts DESC) AS back FROM walk)
SELECT ticker_a, ticker_b, ts, CAST(CASE WHEN hour(ts) >= 21 OR back = 1 THEN 0 ELSE position END AS BIGINT) AS position FROM l""")
def flattened_positions(spark, sf_dir):
    """Positions that are flat from 21:00 or the last bar of the day on."""
    x = walked(spark, sf_dir).withColumn("day", F.to_date("ts"))
    last = F.row_number().over(W.over([*PAIR, "day"], [F.desc("ts")])) == 1
    return x.select(*PAIR, "ts", F.when((F.hour("ts") >= 21) | last, F.lit(0)).otherwise(F.col("position")).cast("bigint").alias("position"))


@query(WALK + """, n AS (SELECT *, row_number() OVER (PARTITION BY ticker_a, ticker_b, trade, position <> 0 ORDER BY ts) AS bar FROM t),
c AS (SELECT *, position <> 0 AND bar > 5 AS cut FROM n)
SELECT ticker_a, ticker_b, ts, CAST(CASE WHEN cut THEN 0 ELSE position END AS BIGINT) AS position, coalesce(lead(cut) OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts), false) AND NOT cut AS forced_exit FROM c""")
def capped_positions(spark, sf_dir):
    """Positions cut after the fifth bar of a trade; the bar before the first one cut is marked as a forced exit."""
    x = walked(spark, sf_dir)
    held = F.col("position") != 0
    x = x.withColumn("bar", F.row_number().over(Window.partitionBy(*PAIR, "trade", held).orderBy("ts")))
    x = x.withColumn("cut", held & (F.col("bar") > 5))
    forced = F.coalesce(F.lead("cut").over(W.over(PAIR, ["ts"])), F.lit(False)) & ~F.col("cut")
    return x.select(*PAIR, "ts", F.when(F.col("cut"), F.lit(0)).otherwise(F.col("position")).cast("bigint").alias("position"), forced.alias("forced_exit"))


@query()
def replayed_exits(spark, sf_dir):
    """Positions replayed with a correlation exit that blocks re-entry, one on a moved spread that doesn't, and entries
    that wait for a confirmed turn (see ``K.replay``)."""
    w, w12 = W.over(PAIR, ["ts"]), W.over(PAIR, ["ts"], (-11, 0))
    s = spreads(spark, sf_dir).withColumns({"ra": F.col("a") - F.lag("a").over(w), "rb": F.col("b") - F.lag("b").over(w)})
    s = s.withColumns({"corr": F.when(F.count(F.col("ra") * F.col("rb")).over(w12) >= 8, W.correlation("ra", "rb", w12)), "mean": F.avg("spread").over(w12), "dev": F.stddev_samp("spread").over(w12)})

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        z, corr, mean, dev, spread = (pdf[c].to_numpy(float, na_value=np.nan) for c in ("z", "corr", "mean", "dev", "spread"))
        held, code = K.replay(z, 1.5, 0.2, corr=corr, floor=-0.6, spread=spread, mean=mean, dev=dev, moved=2.0, confirm=True)
        return pdf.assign(position=held, exit_code=code)

    return K.per_series(s.select(*PAIR, "ts", "z", "corr", "mean", "dev", "spread"), PAIR, ["ts"], kernel, "position bigint, exit_code bigint").select(*PAIR, "ts", "position", "exit_code")


@query(BARS + """, e AS (SELECT ticker, ts, r, exp(sum(ln(1 + greatest(coalesce(r / 100, 0), -1 + 1e-9))) OVER w) AS equity FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
s AS (SELECT ticker, last(equity ORDER BY ts) AS final, count(DISTINCT CAST(ts AS DATE)) AS days, min(dd) AS dd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0 END) AS wins FROM d GROUP BY 1)
SELECT ticker, days, round(pow(final, 252.0 / days) - 1, 8) AS cagr, round(CASE WHEN dd <> 0 THEN (pow(final, 252.0 / days) - 1) / abs(dd) END, 8) AS calmar, round(wins, 6) AS wins FROM s""")
def performance(spark, sf_dir):
    """Annual growth of the compounded equity, that over the largest drawdown (null without one), and the share of winning bars."""
    x = returns(spark, sf_dir).withColumn("equity", W.compounded(F.col("r") / 100, ["ticker"], ["ts"]))
    x = x.withColumn("dd", W.drawdown("equity", ["ticker"], ["ts"]))
    s = x.groupBy("ticker").agg(F.max_by("equity", "ts").alias("final"), F.count_distinct(F.to_date("ts")).alias("days"), F.min("dd").alias("dd"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("wins"))
    cagr = F.when(F.col("final") <= 0, F.lit(-1.0)).otherwise(F.pow("final", F.lit(252.0) / F.col("days")) - 1)
    return s.select("ticker", "days", F.round(cagr, 8).alias("cagr"), F.round(F.when(F.col("dd") != 0, cagr / F.abs("dd")), 8).alias("calmar"), F.round("wins", 6).alias("wins"))


@query(BARS + """, t AS (SELECT DISTINCT ts FROM rets), k AS (SELECT DISTINCT ticker FROM rets),
u AS (SELECT t.ts, k.ticker, coalesce(r.r, 0) AS r FROM t CROSS JOIN k LEFT JOIN rets r ON r.ts = t.ts AND r.ticker = k.ticker)
SELECT ts, round(sum(r) / (SELECT count(*) FROM k), 8) AS r FROM u GROUP BY 1""")
def portfolio_returns(spark, sf_dir):
    """Mean return of all tickers over the union of their times; a ticker without a return there counts as zero.

    No grid is built: what is missing adds nothing to the sum, so only the number of tickers is needed."""
    r = returns(spark, sf_dir)
    many = r.agg(F.count_distinct("ticker").alias("many"))
    total = r.groupBy("ts").agg(F.sum(F.coalesce("r", F.lit(0.0))).alias("r"))
    return total.join(F.broadcast(many)).select("ts", F.round(F.col("r") / F.col("many"), 8).alias("r"))


@query("""WITH o AS (SELECT CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-01-01' THEN 'early' WHEN CAST(o_orderdate AS DATE) < DATE '1997-01-01' THEN 'middle' ELSE 'late' END AS regime, o_totalprice AS p FROM orders)
SELECT regime, count(*) AS n, round(quantile_cont(p, 0.25), 4) AS q1, round(quantile_cont(p, 0.5), 4) AS mid, round(quantile_cont(p, 0.75), 4) AS q3 FROM o GROUP BY 1""")
def regime_quartiles(spark, sf_dir):
    """Exact quartiles per regime; a hot regime is spread over tasks."""
    day = F.to_date("o_orderdate")
    regime = F.when(day < "1995-01-01", "early").when(day < "1997-01-01", "middle").otherwise("late")
    o = table(spark, sf_dir, "orders").select(regime.alias("regime"), F.col("o_totalprice").cast("double").alias("p"))
    q = G.exact_quantiles(o, "regime", "p", [0.25, 0.5, 0.75])
    return q.select("regime", "n", *[F.round(F.col("quantiles")[k], 4).alias(c) for k, c in enumerate(("q1", "mid", "q3"))])


_BOOK = """WITH b AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS day, value AS mid, value - (event_id % 7 - 1) / 100.0 AS b1, value + (event_id % 5) / 100.0 AS a1,
  value - (event_id % 7 + 2) / 100.0 AS b2, value + (event_id % 5 + 3) / 100.0 AS a2, value - (event_id % 7 + 6) / 100.0 AS b3, value + (event_id % 5 + 8) / 100.0 AS a3, event_id % 90 + 10 AS size FROM events WHERE value > 1),
s AS (SELECT *, a1 > b1 AND b1 > 0 AS valid, greatest((a1 - b1) / ((a1 + b1) / 2) * 10000, 0) AS s1, greatest((a2 - b2) / ((a2 + b2) / 2) * 10000, 0) AS s2, greatest((a3 - b3) / ((a3 + b3) / 2) * 10000, 0) AS s3 FROM b)
"""


def book(spark, sf_dir) -> DataFrame:
    """Three levels of quotes around each event's value, with relative spreads in basis points; crossed quotes are kept,
    marked and clipped at zero."""
    e, i, v = table(spark, sf_dir, "events").where("value > 1"), F.col("event_id"), F.col("value")
    b = e.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("day"), (i % 90 + 10).alias("size"), *[
        c for k, (down, up) in enumerate(((-1, 0), (2, 3), (6, 8)), 1) for c in ((v - (i % 7 + down) / 100.0).alias(f"b{k}"), (v + (i % 5 + up) / 100.0).alias(f"a{k}"))
    ])
    bps = {f"s{k}": F.greatest((F.col(f"a{k}") - F.col(f"b{k}")) / ((F.col(f"a{k}") + F.col(f"b{k}")) / 2) * 10000, F.lit(0.0)) for k in (1, 2, 3)}
    return b.withColumns(bps).withColumn("valid", (F.col("a1") > F.col("b1")) & (F.col("b1") > 0))


@query(_BOOK + """SELECT ticker, count(*) AS n, count(*) FILTER (WHERE valid) AS valid, round(avg(s1 / 2), 6) AS half_l1, round(avg(s1), 6) AS l1, round(avg(s2), 6) AS l2, round(avg(s3), 6) AS l3,
round(avg(size * b1) FILTER (WHERE valid), 4) AS liquidity FROM s GROUP BY 1""")
def book_levels(spark, sf_dir):
    """Spreads of three levels, half spread and first-level liquidity of every ticker."""
    return book(spark, sf_dir).groupBy("ticker").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.round(F.avg(F.col("s1") / 2), 6).alias("half_l1"), *[F.round(F.avg(f"s{k}"), 6).alias(f"l{k}") for k in (1, 2, 3)],
        F.round(F.avg(F.when(F.col("valid"), F.col("size") * F.col("b1"))), 4).alias("liquidity"),
    )


@query(_BOOK + """SELECT ticker, count(*) AS n, round(avg(s1), 6) AS mean, round(median(s1), 6) AS mid, round(quantile_cont(s1, 0.95), 6) AS p95, round(quantile_cont(s1, 0.99), 6) AS p99, round(stddev_samp(s1), 6) AS dev FROM s WHERE valid GROUP BY 1""")
def spread_summary(spark, sf_dir):
    """Mean, deviation and exact quantiles of every ticker's valid spreads."""
    b = book(spark, sf_dir).where("valid").select("ticker", "s1")
    m = b.groupBy("ticker").agg(F.round(F.avg("s1"), 6).alias("mean"), F.round(F.stddev_samp("s1"), 6).alias("dev"))
    q = G.exact_quantiles(b, "ticker", "s1", [0.5, 0.95, 0.99])
    return m.join(q, "ticker").select("ticker", "n", "mean", "dev", *[F.round(F.col("quantiles")[k], 6).alias(c) for k, c in enumerate(("mid", "p95", "p99"))])


@query(_BOOK + """, d AS (SELECT ticker, day, avg(s1 / 2) AS half, stddev_samp(s1) AS dev, count(*) AS n FROM s WHERE valid GROUP BY 1, 2)
SELECT ticker, day, round(half, 6) AS half_spread_bps, round(dev, 6) AS spread_std, n AS n_bars FROM d""")
def daily_spreads(spark, sf_dir):
    """Half spread, its deviation and number of valid quotes per ticker and day: one map-side aggregation."""
    b = book(spark, sf_dir).where("valid").groupBy("ticker", "day")
    return b.agg(F.round(F.avg(F.col("s1") / 2), 6).alias("half_spread_bps"), F.round(F.stddev_samp("s1"), 6).alias("spread_std"), F.count("*").alias("n_bars"))


@query(BARS + """, p AS (SELECT ticker, ts, r, lag(r) OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) AS q FROM rets WHERE r IS NOT NULL),
c AS (SELECT *, count(q) OVER w AS n, corr(r, q) OVER w AS c FROM p WINDOW w AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT ticker, ts, CASE WHEN n >= 6 AND NOT isnan(c) THEN round(c, 6) END AS autocorrelation FROM c""")
def rolling_autocorrelation(spark, sf_dir):
    """Lag-one autocorrelation of the last ten known returns within the day."""
    p = returns(spark, sf_dir).where("r is not null").withColumn("day", F.to_date("ts"))
    p = p.withColumn("q", F.lag("r").over(W.over(["ticker", "day"], ["ts"])))
    w = W.over(["ticker", "day"], ["ts"], (-9, 0))
    return p.select("ticker", "ts", F.when(F.count("q").over(w) >= 6, F.round(W.correlation("r", "q", w), 6)).alias("autocorrelation"))


@query(BARS + """, x AS (SELECT ticker, i, close FROM rets), l AS (SELECT unnest(generate_series(2, 19)) AS lag), s AS (SELECT ticker, unnest(generate_series(1, max(i) - 239, 60)) AS start FROM x GROUP BY 1),
d AS (SELECT s.ticker, s.start, l.lag, stddev_samp(b.close - a.close) AS v FROM s JOIN x a ON a.ticker = s.ticker AND a.i BETWEEN s.start AND s.start + 239 JOIN l ON true JOIN x b ON b.ticker = a.ticker AND b.i = a.i + l.lag AND b.i < s.start + 240 GROUP BY 1, 2, 3)
SELECT ticker, start, round(regr_slope(ln(v), ln(lag)), 6) AS hurst FROM d WHERE v > 0 GROUP BY 1, 2""")
def rolling_hurst(spark, sf_dir):
    """Hurst exponent of windows of 240 bars every 60, lags 2 to 19. A bar goes to the four windows it lies in at most."""
    size, step, lags = 240, 60, range(2, 20)
    b = hourly_bars(spark, sf_dir).withColumn("i", F.row_number().over(W.over(["ticker"], ["ts"])))
    b = b.withColumn("n", F.count("*").over(Window.partitionBy("ticker")))
    b = b.withColumns({f"d{k}": F.lead("close", k).over(W.over(["ticker"], ["ts"])) - F.col("close") for k in lags})
    first = F.greatest(F.lit(0), F.floor((F.col("i") - size + step - 1) / step)).cast("int")
    starts = F.filter(F.sequence(first, F.floor((F.col("i") - 1) / step).cast("int")), lambda k: k * step + size <= F.col("n"))
    x = b.select("ticker", "i", *[f"d{k}" for k in lags], F.explode(starts).alias("k")).withColumn("start", (F.col("k") * step + 1).cast("bigint"))
    inside = [F.when(F.col("i") + k < F.col("start") + size, F.col(f"d{k}")) for k in lags]
    wide = x.groupBy("ticker", "start").agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.stddev_samp(d).alias("v")) for k, d in zip(lags, inside)]).alias("a"))
    return wide.select("ticker", "start", F.explode("a").alias("x")).where("x.v > 0").groupBy("ticker", "start").agg(F.round(W.slope(F.ln("x.v"), F.ln("x.lag")), 6).alias("hurst"))


@query(WALK + """, t2 AS (SELECT ticker_a, ticker_b, trade, last(gain ORDER BY ts) > 0 AS won, abs(first(z ORDER BY ts)) AS score FROM h GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM t2)
SELECT count(*) FILTER (WHERE won) AS won, count(*) FILTER (WHERE NOT won) AS lost, round((sum(CASE WHEN won THEN k END) - count(*) FILTER (WHERE won) * (count(*) FILTER (WHERE won) + 1) / 2.0) / nullif(count(*) FILTER (WHERE won) * count(*) FILTER (WHERE NOT won), 0), 8) AS auroc FROM r""")
def score_discrimination(spark, sf_dir):
    """How well the entry score tells winning trades from losing ones: Mann-Whitney over its largest value."""
    t = holding(spark, sf_dir).groupBy(*TRADE).agg((F.max_by("gain", "ts") > 0).alias("won"), F.abs(F.min_by("z", "ts")).alias("score"))
    return G.auroc(t, "won", "score").select(F.col("positive").alias("won"), F.col("negative").alias("lost"), F.round("auroc", 8).alias("auroc"))


@query()
def paired_bootstrap(spark, sf_dir):
    """Difference of the annual Sharpe ratios of two arms (every pair's positions carried out one and two bars later),
    resampled by days as blocks: 1,000 draws of days with replacement, the same ones for both arms."""
    w = W.over(PAIR, ["ts"])
    p = walked(spark, sf_dir).withColumn("move", F.col("spread") - F.lag("spread").over(w))
    p = p.select(F.to_date("ts").alias("block"), *[(F.lag("position", k, 0).over(w) * F.col("move")).alias(c) for k, c in ((1, "arm"), (2, "base"))])
    return paired_difference(p.where("arm is not null and base is not null"), "block", "arm", "base", draws=1000, seed=42)


def paired_difference(results: DataFrame, block: str, arm: str, base: str, draws: int, seed: int) -> DataFrame:
    """(draws, mean, lo, hi) of Sharpe(arm) - Sharpe(base) over resampled blocks; whole blocks are drawn, both arms alike.

    A block enters by its count, sums and sums of squares, so a draw adds up a row per block and never its rows. An arm
    without deviation in a draw has ratio 0; without blocks the result is one row of 0 draws."""
    spark = results.sparkSession
    s = results.groupBy(block).agg(F.count("*").alias("n"), *[f.alias(f"{k}_{c}") for c, k in ((arm, "a"), (base, "b")) for f, k in ((F.sum(c), k + "1"), (F.sum(F.col(c) * F.col(c)), k + "2"))])
    s = s.toDF("block", "n", "a1", "a2", "b1", "b2").withColumn("i", F.row_number().over(Window.orderBy("block")) - 1)  # a row per block
    d = bootstrap_draws(s.count(), draws, seed, spark).join(F.broadcast(s), "i").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "a1", "a2", "b1", "b2")])

    def ratio(k: str) -> Column:
        mean = F.col(f"{k}1") / F.col("n")
        variance = F.try_divide(F.col(f"{k}2") - F.col("n") * mean * mean, F.col("n") - 1)
        return F.when(variance > 1e-20, mean / F.sqrt(variance) * math.sqrt(252)).otherwise(F.lit(0.0))

    x = d.select((ratio("a") - ratio("b")).alias("x"))
    return x.agg(F.count("x").alias("draws"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", 0.025), 6).alias("lo"), F.round(F.percentile("x", 0.975), 6).alias("hi"))


@query()
def negative_control(spark, sf_dir):
    """Every pair's reversion speed against seeded random walks of the same length and step: real if it lies more than two
    deviations beyond the walks' mean."""
    h = P.half_life(spreads(spark, sf_dir), PAIR, "ts").select(*PAIR, "n", "kappa")
    n = h.agg(F.max("n")).head()[0] or 0
    from tidemark.sources.files import random_walk

    walks = random_walk(spark, 64 if n else 0, int(n) + 1 if n else 1).select("ticker", "i", F.ln("value").alias("spread"))
    c = P.half_life(walks, ["ticker"], "i").agg(F.avg("kappa").alias("mu"), F.stddev_samp("kappa").alias("sd"))
    return h.join(F.broadcast(c)).select(*PAIR, F.round("kappa", 6).alias("kappa"), (F.col("kappa") < F.col("mu") - 2 * F.col("sd")).alias("real"))


@query()
def factor_projection(spark, sf_dir):
    """Residual log prices after the last cut, by factor loadings of the days before it (see ``projected_residuals``)."""
    d = materialise(daily_panel(spark, sf_dir).select("ticker", "ts", "value"), "panel")
    before = F.col("ts") < F.lit(CUTS[1]).cast("date")
    r = projected_residuals(d.where(before), d.where(~before), components=5, least_tickers=5, least_rows=5)
    return r.select("ticker", "ts", F.round("residual_log_price", 6).alias("residual_log_price"))


def projected_residuals(formation: DataFrame, trading: DataFrame, components: int = 5, least_tickers: int = 50, least_rows: int = 200) -> DataFrame:
    """(ticker, ts, residual_log_price): out-of-sample residuals of a panel (ticker, ts, value).

    Loadings come from the formation period's complete tickers alone. Of these, the ones complete in the trading period
    are projected: each day's factors are the loadings' products with that day's returns, what they leave is summed from
    the ticker's first log price of the period (the re-anchor), so nothing of the period flows back. Panels below the
    minimums give no rows."""
    loadings = factor_loadings(*complete_returns(formation), components, least_tickers, least_rows)[0]
    w = W.over(["ticker"], ["ts"])
    p = complete_returns(trading)[0].join(loadings, "ticker")
    f = p.where("r is not null").groupBy("ts").agg(F.array(*[F.sum(F.col("w")[k] * F.col("r")) for k in range(components)]).alias("f"))
    fit = sum((F.col("w")[k] * F.col("f")[k] for k in range(components)), F.lit(0.0))
    x = p.join(f, "ts", "left").withColumn("e", F.coalesce(F.col("r") - fit, F.lit(0.0)))
    return x.select("ticker", "ts", (F.first("x").over(w) + F.sum("e").over(w)).alias("residual_log_price"))
