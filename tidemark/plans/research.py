"""Queries on trades, gates, grids and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import gates as G
from tidemark.operators import kernels as K
from tidemark.operators import windows as W
from tidemark.plans.registry import Registry
from tidemark.plans.relations import PAIR, PAIRS, log_pairs, spreads
from tidemark.plans.series import BARS, r6, returns
from tidemark.sources.market import event_ticks, hourly_bars
from tidemark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Positions of every pair, walked bar by bar, and the trades they make.
WALK = PAIRS.replace("WITH ticks", "WITH RECURSIVE ticks", 1) + """, walk AS (
  SELECT ticker_a, ticker_b, i, ts, spread, z, a, b, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS position FROM zs WHERE i = 1
  UNION ALL SELECT n.ticker_a, n.ticker_b, n.i, n.ts, n.spread, n.z, n.a, n.b, CASE WHEN n.z IS NULL THEN w.position WHEN w.position = 1 THEN CASE WHEN n.z >= -0.2 THEN 0 ELSE 1 END
    WHEN w.position = -1 THEN CASE WHEN n.z <= 0.2 THEN 0 ELSE -1 END WHEN n.z < -1.5 THEN 1 WHEN n.z > 1.5 THEN -1 ELSE 0 END
  FROM walk w JOIN zs n ON n.ticker_a = w.ticker_a AND n.ticker_b = w.ticker_b AND n.i = w.i + 1),
e AS (SELECT *, CASE WHEN position <> 0 AND position <> coalesce(lag(position) OVER w, 0) THEN 1 ELSE 0 END AS entered FROM walk WINDOW w AS (PARTITION BY ticker_a, ticker_b ORDER BY ts)),
t AS (SELECT *, sum(entered) OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts) AS trade FROM e),
h AS (SELECT *, row_number() OVER x AS bar, position * (spread - first(spread) OVER x) AS gain FROM t WHERE position <> 0 WINDOW x AS (PARTITION BY ticker_a, ticker_b, trade ORDER BY ts))
"""
TRADE = [*PAIR, "trade"]


def walked(spark, sf_dir) -> DataFrame:
    """Spreads with positions and trade numbers."""
    return K.trades(K.with_positions(spreads(spark, sf_dir), PAIR, ["ts"], "z", 1.5, 0.2), PAIR, ["ts"])


def holding(spark, sf_dir) -> DataFrame:
    """Bars of trades with their number in the trade and the gain since its entry."""
    h, w = walked(spark, sf_dir).where("position <> 0"), W.over(TRADE, ["ts"])
    return h.withColumns({"bar": F.row_number().over(w), "gain": F.col("position") * (F.col("spread") - F.first("spread").over(w))})


@query("""SELECT event_type AS ticker, count(*) AS n, count(*) FILTER (WHERE ask > bid AND bid > 0) AS valid, round(avg(greatest((ask - bid) / ((ask + bid) / 2) * 10000, 0)), 6) AS spread_bps
FROM (SELECT event_type, value - (event_id % 7 - 1) / 100.0 AS bid, value + (event_id % 5) / 100.0 AS ask FROM events WHERE value > 1) GROUP BY 1""")
def microstructure(spark, sf_dir):
    """Validity and relative spread of quotes; crossed ones are marked and clipped, never dropped."""
    e = table(spark, sf_dir, "events").where("value > 1")
    bid, ask = F.col("value") - (F.col("event_id") % 7 - 1) / 100.0, F.col("value") + (F.col("event_id") % 5) / 100.0
    q = e.select(F.col("event_type").alias("ticker"), bid.alias("bid"), ask.alias("ask"))
    bps = F.greatest((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10000, F.lit(0.0))
    return q.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if((F.col("ask") > F.col("bid")) & (F.col("bid") > 0)).alias("valid"), F.round(F.avg(bps), 6).alias("spread_bps"))


@query("""WITH d AS (SELECT *, CAST(ts AS DATE) AS day FROM events) SELECT CASE WHEN day < DATE '2024-01-21' THEN 'formation' ELSE 'trading' END AS period, count(*) AS n, min(day) AS since, max(day) AS until FROM d GROUP BY 1""")
def period_split(spark, sf_dir):
    """Formation and trading periods; the split refuses to let them overlap."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    form, trade = G.split_periods(e, "day", ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-12-31"))
    both = form.withColumn("period", F.lit("formation")).unionByName(trade.withColumn("period", F.lit("trading")))
    return both.groupBy("period").agg(F.count("*").alias("n"), F.min("day").alias("since"), F.max("day").alias("until"))


@query("""WITH u AS (SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= (SELECT avg(c) FROM (SELECT count(*) AS c FROM bars GROUP BY ticker)))
SELECT DISTINCT upper(trim(pair_id)) AS pair FROM pair_list p WHERE EXISTS (SELECT 1 FROM u WHERE u.ticker = p.ticker_a) AND EXISTS (SELECT 1 FROM u WHERE u.ticker = p.ticker_b)""")
def tradable_pairs(spark, sf_dir):
    """Pairs both of whose legs are in a universe: two semi joins."""
    n = table(spark, sf_dir, "bars").groupBy("ticker").agg(F.count("*").alias("c"))
    u = n.join(F.broadcast(n.agg(F.avg("c").alias("m")))).where("c >= m").select("ticker")
    p = table(spark, sf_dir, "pair_list")
    for leg in ("ticker_a", "ticker_b"):
        p = p.join(u, p[leg] == u["ticker"], "left_semi")
    return p.select(F.upper(F.trim("pair_id")).alias("pair")).distinct()


@query(BARS + """, g AS (SELECT t.ticker, s.ts FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT ts FROM bars) s),
f AS (SELECT g.ticker, g.ts, b.close, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS filled FROM g LEFT JOIN bars b ON b.ticker = g.ticker AND b.ts = g.ts)
SELECT ticker, ts, close, filled FROM f""")
def outer_align(spark, sf_dir):
    """All tickers on the union of their times, the last value carried forward."""
    b = hourly_bars(spark, sf_dir).select("ticker", "ts", "close")
    span = F.broadcast(b.agg(F.min("ts").alias("a"), F.max("ts").alias("z")))  # one row
    hours = F.explode(F.sequence("a", "z", F.expr("interval 1 hour"))).alias("ts")
    grid = b.select("ticker").distinct().join(span).select("ticker", hours).join(b.select("ts").distinct(), "ts", "left_semi")
    filled = F.last("close", ignorenulls=True).over(W.over(["ticker"], ["ts"], (Window.unboundedPreceding, 0)))
    return grid.join(b, ["ticker", "ts"], "left").withColumn("filled", filled).select("ticker", "ts", "close", "filled")


@query(BARS + """, m AS (SELECT ticker, hour(ts) // 6 AS bucket, median(close) AS mid FROM bars WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2)
SELECT b.ticker, b.ts, round(b.close - m.mid, 6) AS adjusted FROM bars b LEFT JOIN m ON m.ticker = b.ticker AND m.bucket = hour(b.ts) // 6""")
def seasonal_adjustment(spark, sf_dir):
    """Closes less their bucket's median of the formation period: an equi-join on ticker and bucket."""
    b = hourly_bars(spark, sf_dir).withColumn("bucket", (F.hour("ts") / 6).cast("int"))
    m = b.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).groupBy("ticker", "bucket").agg(F.median("close").alias("mid"))
    return b.join(m, ["ticker", "bucket"], "left").select("ticker", "ts", F.round(F.col("close") - F.col("mid"), 6).alias("adjusted"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS lines, coalesce(total, 0) AS total FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_discount > 0.03 GROUP BY 1) ON l_orderkey = o_orderkey""")
def child_sums(spark, sf_dir):
    """Children summed per parent before the join, parents without any kept."""
    l = table(spark, sf_dir, "lineitem").where("l_discount > 0.03").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("t"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("t", F.lit(0.0)).alias("total"))


@query("""WITH m AS (SELECT o_custkey AS k, o_orderstatus AS arm, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.k, round(a.v, 8) AS v_f, round(b.v, 8) AS v_o, round(b.v - a.v, 8) AS lift FROM m a JOIN m b ON a.k = b.k AND a.arm = 'F' AND b.arm = 'O'""")
def arm_comparison(spark, sf_dir):
    """Two arms of an experiment side by side, by key."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("arm")).agg(F.avg("o_totalprice").alias("v"))
    a, b = (m.where(F.col("arm") == x).select("k", F.col("v").alias(f"v_{x.lower()}")) for x in "FO")
    return a.join(b, "k").select("k", F.round("v_f", 8).alias("v_f"), F.round("v_o", 8).alias("v_o"), F.round(F.col("v_o") - F.col("v_f"), 8).alias("lift"))


@query("""SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without""")
def semi_anti(spark, sf_dir):
    """Customers with and without orders, by semi and anti join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = c["c_custkey"] == o["o_custkey"]
    have, lack = (c.join(o, on, how).agg(F.count("*").alias(n)) for how, n in (("left_semi", "with_orders"), ("left_anti", "without")))
    return have.join(lack)


@query("""WITH p AS (SELECT upper(trim(pair_id)) AS pair, realized_pnl AS p FROM trades_eow WHERE pair_id IS NOT NULL AND NOT isnan(realized_pnl))
SELECT pair, count(*) AS n, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END), 6) AS wins, round(sum(p), 4) AS total, round(quantile_cont(p, 0.25), 6) AS q1, round(median(p), 6) AS mid, round(quantile_cont(p, 0.75), 6) AS q3 FROM p GROUP BY 1""")
def pair_trade_stats(spark, sf_dir):
    """Trades per pair: count, winners, sum and quartiles."""
    t = table(spark, sf_dir, "trades_eow").where("pair_id is not null and realized_pnl is not null and not isnan(realized_pnl)")
    p = "realized_pnl"
    return t.groupBy(F.upper(F.trim("pair_id")).alias("pair")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col(p) > 0).cast("double")), 6).alias("wins"), F.round(F.sum(p), 4).alias("total"),
        F.round(F.percentile(p, 0.25), 6).alias("q1"), F.round(F.median(p), 6).alias("mid"), F.round(F.percentile(p, 0.75), 6).alias("q3"),
    )


@query("""WITH r AS (SELECT * FROM (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'), ('middle', DATE '1997-01-01', DATE '1999-12-31'), ('never', DATE '2050-01-01', DATE '2050-12-31')) AS r(regime, a, b))
SELECT regime, count(o_orderkey) AS n, round(avg(o_totalprice), 4) AS mean, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 WHEN o_totalprice IS NOT NULL THEN 0 END), 6) AS share FROM r LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY 1""")
def regime_stats(spark, sf_dir):
    """Statistics per named regime, regimes without rows included."""
    names = spark.createDataFrame([("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("never", "2050-01-01", "2050-12-31")], "regime string, a string, b string")
    folds = names.select(F.col("regime").alias("fold"), F.to_date("a").alias("start"), F.to_date("b").alias("end"))
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    s = B.in_folds(o, "day", folds).groupBy(F.col("fold").alias("regime")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.min("o_totalprice"), 4).alias("least"), F.round(F.max("o_totalprice"), 4).alias("most"),
        F.round(F.avg((F.col("o_totalprice") > 100000).cast("double")), 6).alias("share"),
    )
    return names.select("regime").join(s, "regime", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""WITH s AS (SELECT order_no, CASE WHEN pair_id IS NULL THEN 'no pair' WHEN filled_ts IS NULL THEN 'no time' WHEN isnan(fill_price) OR fill_price IS NULL THEN 'no price' ELSE 'kept' END AS stage FROM live_orders)
SELECT stage, count(*) AS n, min(order_no) AS example, round(count(*) * 100.0 / (SELECT count(*) FROM s), 4) AS pct FROM s GROUP BY 1""")
def filter_funnel(spark, sf_dir):
    """Rows by the first rule they fail, with an example of each."""
    o = table(spark, sf_dir, "live_orders")
    stage = F.when(F.col("pair_id").isNull(), "no pair").when(F.col("filled_ts").isNull(), "no time").when(F.col("fill_price").isNull() | F.isnan("fill_price"), "no price").otherwise("kept")
    n = o.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.min("order_no").alias("example"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("stage", "n", "example", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("pct"))


@query("""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), p AS (SELECT * FROM (VALUES (1, 0.0), (2, 5.0), (3, 20.0)) AS p(setting, bps))
SELECT setting, round(avg(v * (1 - bps / 10000)), 4) AS mean, round(avg(v * (1 - bps / 10000)) / stddev_samp(v), 8) AS ratio FROM d, p GROUP BY 1""")
def parameter_grid(spark, sf_dir):
    """One parameter at a time: every setting over the same days in one aggregation."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("v"))
    settings = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(b).alias("bps")) for k, b in ((1, 0.0), (2, 5.0), (3, 20.0))]))
    net = F.col("v") * (1 - F.col("p.bps") / 10000)
    return d.select("v", settings.alias("p")).groupBy("p.setting").agg(F.round(F.avg(net), 4).alias("mean"), F.round(F.try_divide(F.avg(net), F.stddev_samp("v")), 8).alias("ratio"))


@query(BARS + """SELECT ticker, ts, round(avg(CASE WHEN r IS NULL OR abs(r) < 0.1 THEN 1.0 ELSE 0 END) OVER w, 6) AS stale, round(avg(CASE WHEN abs(r) > 1 THEN 1.0 ELSE 0 END) OVER w, 6) AS jumps FROM rets
WINDOW w AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def staleness(spark, sf_dir):
    """Share of still and of jumping bars in a rolling window within the day; missing counts as still."""
    x, w = returns(spark, sf_dir).withColumn("day", F.to_date("ts")), W.over(["ticker", "day"], ["ts"], (-5, 0))
    still = (F.col("r").isNull() | (F.abs("r") < 0.1)).cast("double")
    jump = F.coalesce((F.abs("r") > 1).cast("double"), F.lit(0.0))
    return x.select("ticker", "ts", F.round(F.avg(still).over(w), 6).alias("stale"), F.round(F.avg(jump).over(w), 6).alias("jumps"))


@query(PAIRS + """SELECT ticker_a, ticker_b, CASE WHEN z IS NULL THEN 'none' WHEN z > 1.5 THEN 'short' WHEN z < -1.5 THEN 'long' WHEN abs(z) <= 0.2 THEN 'exit' ELSE 'hold' END AS zone, count(*) AS n FROM zs GROUP BY 1, 2, 3""")
def zones(spark, sf_dir):
    """Bars by the zone of their z-score, without memory."""
    z = F.col("z")
    zone = F.when(z.isNull(), "none").when(z > 1.5, "short").when(z < -1.5, "long").when(F.abs(z) <= 0.2, "exit").otherwise("hold")
    return spreads(spark, sf_dir).groupBy(*PAIR, zone.alias("zone")).agg(F.count("*").alias("n"))


@query(WALK + """, l AS (SELECT *, row_number() OVER (PARTITION BY ticker_a, ticker_b, CAST(ts AS DATE) ORDER BY ts DESC) AS back FROM walk)
SELECT ticker_a, ticker_b, count(*) FILTER (WHERE position <> 0) AS held, count(*) FILTER (WHERE position <> 0 AND NOT (hour(ts) >= 21 OR back = 1)) AS held_flat FROM l GROUP BY 1, 2""")
def session_flatten(spark, sf_dir):
    """Bars held, and bars held when every position is flat from 21:00 or the last bar of the day on."""
    x = walked(spark, sf_dir).withColumn("day", F.to_date("ts"))
    x = x.withColumn("back", F.row_number().over(W.over([*PAIR, "day"], [F.desc("ts")])))
    flat = (F.hour("ts") >= 21) | (F.col("back") == 1)
    return x.groupBy(*PAIR).agg(F.count_if(F.col("position") != 0).alias("held"), F.count_if((F.col("position") != 0) & ~flat).alias("held_flat"))


@query(WALK + "SELECT ticker_a, ticker_b, count(*) FILTER (WHERE bar > 5) AS cut, count(DISTINCT CASE WHEN bar > 5 THEN trade END) AS trades FROM h GROUP BY 1, 2")
def holding_cap(spark, sf_dir):
    """Bars beyond the longest holding, and the trades they belong to."""
    over = F.col("bar") > 5
    return holding(spark, sf_dir).groupBy(*PAIR).agg(F.count_if(over).alias("cut"), F.count_distinct(F.when(over, F.col("trade"))).alias("trades"))


@query(WALK + """, s AS (SELECT ticker_a, ticker_b, trade, min(bar) FILTER (WHERE gain <= -0.3) AS stop_bar, max(bar) AS last_bar FROM h GROUP BY 1, 2, 3)
SELECT s.ticker_a, s.ticker_b, s.trade, s.stop_bar, round(h.gain, 6) AS result FROM s JOIN h ON h.ticker_a = s.ticker_a AND h.ticker_b = s.ticker_b AND h.trade = s.trade AND h.bar = least(coalesce(s.stop_bar, s.last_bar), 8, s.last_bar)""")
def exit_simulator(spark, sf_dir):
    """Each trade ended at its first bar beyond the stop, after eight bars, or at its last bar, whichever is first."""
    h = holding(spark, sf_dir)
    ends = (F.col("gain") <= -0.3) | (F.col("bar") >= 8)
    s = h.groupBy(*TRADE).agg(
        F.min(F.when(F.col("gain") <= -0.3, F.col("bar"))).alias("stop_bar"),
        F.coalesce(F.min_by(F.when(ends, F.col("gain")), F.when(ends, F.col("bar"))), F.max_by("gain", "bar")).alias("result"),
    )
    return s.select(*TRADE, "stop_bar", F.round("result", 6).alias("result"))


@query(WALK + """SELECT ticker_a, ticker_b, trade, CASE WHEN max(abs(z)) > 1.1 * abs(first(z ORDER BY ts)) THEN true ELSE false END AS diverged, min(abs(z)) < 0.5 AS reverted,
CASE WHEN last(gain ORDER BY ts) >= 0 THEN 'REVERT' WHEN regr_slope(gain, bar) < -0.05 THEN 'TREND' ELSE 'DRIFT' END AS label FROM h GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def trade_labels(spark, sf_dir):
    """How trades of three bars and more went: diverged, reverted, and a label by their course."""
    z = F.abs("z")
    label = F.when(F.max_by("gain", "ts") >= 0, "REVERT").when(W.slope("gain", "bar") < -0.05, "TREND").otherwise("DRIFT")
    return holding(spark, sf_dir).groupBy(*TRADE).agg(
        (F.max(z) > 1.1 * F.abs(F.min_by("z", "ts"))).alias("diverged"), (F.min(z) < 0.5).alias("reverted"), label.alias("label"), F.count("*").alias("n")
    ).where("n >= 3").drop("n")


@query(WALK + """, r AS (SELECT *, a - lag(a) OVER w AS ra, b - lag(b) OVER w AS rb FROM h WINDOW w AS (PARTITION BY ticker_a, ticker_b, trade ORDER BY ts)),
c AS (SELECT *, count(ra * rb) OVER w AS n, corr(ra, rb) OVER w AS c FROM r WINDOW w AS (PARTITION BY ticker_a, ticker_b, trade ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT ticker_a, ticker_b, trade, min(ts) AS broke_at FROM c WHERE n >= 4 AND c < -0.5 GROUP BY 1, 2, 3""")
def correlation_exit(spark, sf_dir):
    """The first bar of a trade at which the rolling correlation of the legs' returns breaks down."""
    w, w6 = W.over(TRADE, ["ts"]), W.over(TRADE, ["ts"], (-5, 0))
    r = holding(spark, sf_dir).withColumns({"ra": F.col("a") - F.lag("a").over(w), "rb": F.col("b") - F.lag("b").over(w)})
    c = r.withColumns({"n": F.count(F.col("ra") * F.col("rb")).over(w6), "c": W.correlation("ra", "rb", w6)})
    return c.where("n >= 4 and c < -0.5").groupBy(*TRADE).agg(F.min("ts").alias("broke_at"))


@query(PAIRS + """, t AS (SELECT *, row_number() OVER (PARTITION BY ticker_a, ticker_b ORDER BY ts DESC) AS back FROM pairs)
SELECT ticker_a, ticker_b, round(avg(t.a - s.beta * t.b), 6) AS alpha_refit, round(regr_slope(t.a, t.b), 6) AS beta_short FROM t JOIN stats s USING (ticker_a, ticker_b) WHERE back <= 60 GROUP BY 1, 2""")
def refit(spark, sf_dir):
    """Intercept by the last 60 uncentred spreads, and the hedge ratio of these bars alone."""
    p = log_pairs(spark, sf_dir)
    s = p.groupBy(*PAIR).agg(W.slope("a", "b").alias("beta"))
    t = p.withColumn("back", F.row_number().over(W.over(PAIR, [F.desc("ts")]))).where("back <= 60").join(s, PAIR)
    return t.groupBy(*PAIR).agg(F.round(F.avg(F.col("a") - F.col("beta") * F.col("b")), 6).alias("alpha_refit"), F.round(W.slope("a", "b"), 6).alias("beta_short"))


@query(PAIRS + """, k AS (SELECT ticker_a, ticker_b, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS block, a, b FROM pairs),
c AS (SELECT ticker_a, ticker_b, max(c) FILTER (WHERE block = 1) AS c1, max(c) FILTER (WHERE block = 2) AS c2, max(c) FILTER (WHERE block = 3) AS c3 FROM (SELECT ticker_a, ticker_b, block, corr(a, b) AS c FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT ticker_a, ticker_b, CASE WHEN c1 IS NULL OR c2 IS NULL OR c3 IS NULL THEN 'missing' WHEN c3 < -0.05 THEN 'floor' WHEN c1 > c2 AND c2 > c3 AND c1 - c3 >= 0.15 THEN 'decay' ELSE 'kept' END AS gate FROM c""")
def stability_gate(spark, sf_dir):
    """Correlation by three blocks of time, and the first rule that turns a pair down."""
    cuts = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21")]
    return G.correlation_gate(log_pairs(spark, sf_dir), PAIR, "ts", cuts, floor=-0.05, decay=0.15)


@query(WALK + """, x AS (SELECT *, lag(position, 1, 0) OVER w AS held, lag(ts) OVER w AS signal_ts FROM walk WINDOW w AS (PARTITION BY ticker_a, ticker_b ORDER BY ts))
SELECT count(*) FILTER (WHERE signal_ts IS NOT NULL AND signal_ts >= ts) AS early, count(*) AS bars, sum(CASE WHEN held <> position THEN 1 ELSE 0 END) AS differ FROM x""")
def look_ahead_proof(spark, sf_dir):
    """Bars on which a carried-out position would know its own bar: there must be none."""
    w = W.over(PAIR, ["ts"])
    x = walked(spark, sf_dir).withColumns({"held": F.lag("position", 1, 0).over(w), "signal_ts": F.lag("ts").over(w)})
    return x.agg(F.count_if(F.col("signal_ts") >= F.col("ts")).alias("early"), F.count("*").alias("bars"), F.sum((F.col("held") != F.col("position")).cast("int")).alias("differ"))


@query(PAIRS + """SELECT ticker_a, ticker_b, var_samp(spread) < 1e-14 OR kurtosis_pop(spread) > 10 AS degenerate, round(var_samp(spread), 6) AS v FROM spreads GROUP BY 1, 2""")
def degenerate_spreads(spark, sf_dir):
    """Spreads that hardly vary or have extreme tails."""
    s = spreads(spark, sf_dir).groupBy(*PAIR)
    return s.agg(((F.var_samp("spread") < 1e-14) | (F.kurtosis("spread") > 10)).alias("degenerate"), F.round(F.var_samp("spread"), 6).alias("v"))


@query("""SELECT ticker, order_no, submitted_ts FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY submitted_ts DESC, order_no DESC) AS k FROM live_orders WHERE ticker IS NOT NULL) WHERE k <= 3""")
def latest_n(spark, sf_dir):
    """The three latest orders of every ticker."""
    o = table(spark, sf_dir, "live_orders").where("ticker is not null")
    k = F.row_number().over(W.over(["ticker"], [F.desc("submitted_ts"), F.desc("order_no")]))
    return o.withColumn("k", k).where("k <= 3").select("ticker", "order_no", "submitted_ts")


@query(BARS + """, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM daily), s AS (SELECT ticker, median(value * volume) AS turnover, max(ts) AS latest, count(*) AS days FROM t WHERE back <= 20 GROUP BY 1)
SELECT ticker, round(turnover, 6) AS turnover FROM s WHERE latest >= (SELECT max(ts) FROM daily) - 5 AND days >= 15 ORDER BY turnover DESC, ticker LIMIT 50""")
def liquid_universe(spark, sf_dir):
    """The fifty most liquid tickers among those recent and long enough (a top-k report)."""
    from tidemark.sources.market import daily_panel

    d = daily_panel(spark, sf_dir)
    t = d.withColumn("back", F.row_number().over(W.over(["ticker"], [F.desc("ts")]))).where("back <= 20")
    s = t.groupBy("ticker").agg(F.median(F.col("value") * F.col("volume")).alias("raw"), F.max("ts").alias("latest"), F.count("*").alias("days"))
    s = s.join(F.broadcast(d.agg(F.max("ts").alias("end")))).where((F.col("latest") >= F.date_sub("end", 5)) & (F.col("days") >= 15))
    return s.orderBy(F.desc("raw"), "ticker").limit(50).select("ticker", F.round("raw", 6).alias("turnover"))


@query("""SELECT 'open' AS part, count(*) AS n, NULL::DOUBLE AS pnl FROM positions WHERE exit_ts IS NULL UNION ALL SELECT 'closed', count(*), round(sum(realized_pnl) FILTER (WHERE NOT isnan(realized_pnl)), 4) FROM positions WHERE exit_ts IS NOT NULL""")
def union_parts(spark, sf_dir):
    """Parts of different columns put together by name."""
    p = table(spark, sf_dir, "positions")
    closed = p.where("exit_ts is not null").agg(F.lit("closed").alias("part"), F.count("*").alias("n"), F.round(F.sum(F.when(~F.isnan("realized_pnl"), F.col("realized_pnl"))), 4).alias("pnl"))
    return p.where("exit_ts is null").agg(F.lit("open").alias("part"), F.count("*").alias("n")).unionByName(closed, allowMissingColumns=True)


@query()
def engle_granger(spark, sf_dir):
    """Engle-Granger test of every pair: the residual's augmented Dickey-Fuller statistic, its lag chosen by AIC."""
    return G.engle_granger(log_pairs(spark, sf_dir), PAIR, "ts")


@query()
def noise_grid(spark, sf_dir):
    """Every pair's filter over a grid of state noises, and how white the standardised spread is."""
    p = log_pairs(spark, sf_dir)
    deltas = F.explode(F.array(*[F.lit(10.0**-k) for k in (2, 3, 4, 5)]))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        s, _, _ = K.kalman(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), float(pdf["delta"].iloc[0]), 1e-2)
        return pdf.assign(spread=s)

    k = K.per_series(p.withColumn("delta", deltas), [*PAIR, "delta"], ["ts"], kernel, "spread double")
    k = k.withColumn("before", F.lag("spread").over(W.over([*PAIR, "delta"], ["ts"])))
    return k.groupBy(*PAIR, "delta").agg(F.round(F.kurtosis("spread"), 6).alias("kurtosis"), F.round(W.correlation("spread", "before"), 6).alias("autocorrelation"))


@query()
def deflated_ratio(spark, sf_dir):
    """Each trade series' ratio of mean to deviation, deflated for the number of series tried."""
    h = holding(spark, sf_dir).groupBy(*TRADE).agg(F.max_by("gain", "bar").alias("result"))
    return G.deflated_ratio(h, PAIR, "result")
