"""Queries on single series: bars, quality rules, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import windows as W
from tidemark.plans.registry import Registry
from tidemark.sources.market import daily_panel, event_ticks, hourly_bars
from tidemark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: The bars the SQL below starts from.
BARS = """
WITH ticks AS (SELECT event_id, event_type AS ticker, user_id, ts, value AS price, CAST(json_extract(props, '$.k') AS DOUBLE) AS size FROM events),
bars AS (
  SELECT ticker, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, event_id) AS close, sum(size) AS volume, count(*) AS n, sum(price * size) / nullif(sum(size), 0) AS vwap
  FROM ticks GROUP BY 1, date_trunc('hour', ts)),
daily AS (
  SELECT user_id AS ticker, CAST(ts AS DATE) AS ts, last(price ORDER BY ts, event_id) AS value, sum(size) AS volume
  FROM ticks GROUP BY 1, CAST(ts AS DATE)),
rets AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r, row_number() OVER w AS i
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))
"""


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with logarithmic return ``r`` and position ``i``."""
    w = W.over(["ticker"], ["ts"])
    return hourly_bars(spark, sf_dir).withColumns({"r": W.log_return("close", w), "i": F.row_number().over(w)})


@query(BARS + "SELECT ticker, ts, open, high, low, close, volume, n, round(vwap, 9) AS vwap FROM bars")
def bars_resample(spark, sf_dir):
    """Ticks to hourly bars."""
    return hourly_bars(spark, sf_dir).select("ticker", "ts", "open", "high", "low", "close", "volume", "n", F.round("vwap", 9).alias("vwap"))


@query(BARS + """SELECT ticker, date_trunc('day', ts) AS period, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume, sum(n) AS n FROM bars GROUP BY 1, 2""")
def bars_daily(spark, sf_dir):
    """Hourly bars to daily bars."""
    return B.coarser(hourly_bars(spark, sf_dir), ["ticker"], F.date_trunc("day", "ts"))


@query(BARS + """, d AS (SELECT ticker, CAST(ts AS DATE) AS day, sum(volume) AS volume FROM bars GROUP BY 1, 2),
s AS (SELECT ticker, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS t FROM d GROUP BY 1)
SELECT s.ticker, CAST(s.t AS DATE) AS day, coalesce(d.volume, 0) AS volume FROM s LEFT JOIN d ON d.ticker = s.ticker AND d.day = CAST(s.t AS DATE)
WHERE isodow(s.t) < 6""")
def business_days(spark, sf_dir):
    """Daily volumes on every weekday, the empty ones included."""
    daily = hourly_bars(spark, sf_dir).groupBy("ticker", F.to_date("ts").alias("day")).agg(F.sum("volume").alias("volume"))
    return B.on_weekdays(daily, ["ticker"], "day", ["volume"])


@query("""SELECT event_type AS ticker, count(*) AS n, round(avg(value), 6) AS mean FROM events
WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959 AND isodow(ts) < 6 GROUP BY 1""")
def session_filter(spark, sf_dir):
    """Ticks of regular sessions (09:30 to 15:59, weekdays) per ticker."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    kept = event_ticks(spark, sf_dir).where(minute.between(570, 959) & (F.weekday("ts") < 5))
    return kept.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"))


@query("""SELECT ticker, count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close)) AS bad_bounds,
count(*) FILTER (WHERE close <= 0) AS bad_price, count(*) FILTER (WHERE volume < 0) AS bad_volume,
count(*) FILTER (WHERE close IS NULL OR volume IS NULL) AS incomplete, count(*) - count(DISTINCT trim(ts_date)) AS repeated
FROM bars GROUP BY 1""")
def dq_assertions(spark, sf_dir):
    """Violations of the hard rules per ticker of the daily bars, in one aggregation."""
    b = table(spark, sf_dir, "bars")
    bounds = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return b.groupBy("ticker").agg(
        F.count("*").alias("n"), F.count_if(bounds).alias("bad_bounds"), F.count_if(F.col("close") <= 0).alias("bad_price"),
        F.count_if(F.col("volume") < 0).alias("bad_volume"), F.count_if(F.col("close").isNull() | F.col("volume").isNull()).alias("incomplete"),
        (F.count("*") - F.count_distinct(F.trim("ts_date"))).alias("repeated"),
    )


@query(BARS + """, m AS (SELECT ticker, median(close) AS mid FROM bars GROUP BY 1),
g AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY ticker ORDER BY ts), ts) AS gap FROM bars)
SELECT g.ticker, count(*) FILTER (WHERE close < 0.1 * mid OR close > 10 * mid) AS off_level, count(*) FILTER (WHERE gap <> 3600) AS off_cadence,
round(any_value(mid), 6) AS mid FROM g JOIN m USING (ticker) GROUP BY 1""")
def dq_audit(spark, sf_dir):
    """Bars far off their ticker's median, and breaks of the cadence."""
    b = hourly_bars(spark, sf_dir)
    mid = b.groupBy("ticker").agg(F.median("close").alias("mid"))
    gap = F.unix_seconds(F.col("ts").cast("timestamp"))
    g = b.withColumn("gap", gap - F.lag(gap).over(W.over(["ticker"], ["ts"]))).join(mid, "ticker")
    return g.groupBy("ticker").agg(
        F.count_if((F.col("close") < 0.1 * F.col("mid")) | (F.col("close") > 10 * F.col("mid"))).alias("off_level"),
        F.count_if(F.col("gap") != 3600).alias("off_cadence"), F.round(F.max("mid"), 6).alias("mid"),
    )


@query(BARS + """, z AS (SELECT *, CASE WHEN count(r) OVER w >= 2 THEN (r - avg(r) OVER w) / greatest(stddev_samp(r) OVER w, 1e-10) END AS z
  FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN abs(z) > 2 THEN NULL ELSE close END AS kept FROM z)
SELECT ticker, ts, round(z, 6) AS z, coalesce(kept, lag(kept) OVER (PARTITION BY ticker ORDER BY ts)) AS clean FROM c""")
def dq_outlier(spark, sf_dir):
    """Closes whose return is an outlier of its rolling window give way to the close before, once."""
    w = W.over(["ticker"], ["ts"], (-49, 0))
    x = returns(spark, sf_dir).withColumn("z", W.zscore(F.col("r"), w, 2))
    x = x.withColumn("kept", F.when(F.coalesce(F.abs("z") > 2, F.lit(False)), None).otherwise(F.col("close")))
    return x.select("ticker", "ts", *r6("z"), F.coalesce("kept", F.lag("kept").over(W.over(["ticker"], ["ts"]))).alias("clean"))


@query(BARS + """, q AS (SELECT ticker, ts, floor(close / 40) AS q FROM bars),
f AS (SELECT *, CASE WHEN q IS NOT DISTINCT FROM lag(q) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts) AS run FROM f)
SELECT ticker, min(ts) AS since, max(ts) AS until, count(*) AS n FROM i GROUP BY ticker, run HAVING count(*) >= 4""")
def dq_stale_runs(spark, sf_dir):
    """Runs of at least four bars on one (coarse) price."""
    q = hourly_bars(spark, sf_dir).withColumn("q", F.floor(F.col("close") / 40))
    runs = W.runs(q, ["ticker"], ["ts"], F.col("q")).groupBy("ticker", "run")
    return runs.agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("n")).where("n >= 4").drop("run")


@query(BARS + """, s AS (SELECT ticker, CAST(ts AS DATE) AS day, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY 1, 2)
SELECT s.ticker, s.day, s.ts FROM s ANTI JOIN bars b ON b.ticker = s.ticker AND b.ts = s.ts""")
def dq_gaps(spark, sf_dir):
    """Hours without a bar between the first and last one of each ticker's day."""
    return B.missing_periods(hourly_bars(spark, sf_dir), ["ticker"], "ts")


@query(BARS + """, z AS (SELECT ticker, ts, i,
  CASE WHEN count(r) OVER w >= 2 THEN (r - avg(r) OVER w) / greatest(stddev_samp(r) OVER w, 1e-10) END AS rz,
  CASE WHEN count(volume) OVER w >= 2 THEN (volume - avg(volume) OVER w) / greatest(stddev_samp(volume) OVER w, 1e-10) END AS vz
  FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT ticker, ts, round(rz, 6) AS rz, round(vz, 6) AS vz FROM z WHERE abs(vz) > 2 AND abs(rz) < 1""")
def dq_incoherence(spark, sf_dir):
    """Bars of unusual volume without a move of the price."""
    w = W.over(["ticker"], ["ts"], (-99, 0))
    x = returns(spark, sf_dir).withColumns({"rz": W.zscore(F.col("r"), w, 2), "vz": W.zscore(F.col("volume"), w, 2)})
    return x.where((F.abs("vz") > 2) & (F.abs("rz") < 1)).select("ticker", "ts", *r6("rz", "vz"))


@query(BARS + """, d AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, sum(CASE WHEN price > 100 THEN size ELSE 0 END) AS volume FROM ticks GROUP BY 1, 2),
halts AS (SELECT day FROM d GROUP BY 1 HAVING avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) > 0.9)
SELECT ticker, count(*) AS empty_days FROM d ANTI JOIN halts ON halts.day = d.day WHERE volume = 0 GROUP BY 1""")
def dq_zero_volume(spark, sf_dir):
    """Days without volume per ticker, days on which nearly all have none left aside."""
    t = event_ticks(spark, sf_dir)
    d = t.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day")).agg(F.sum(F.when(F.col("price") > 100, F.col("size")).otherwise(0)).alias("volume"))
    halts = d.groupBy("day").agg(F.avg((F.col("volume") == 0).cast("double")).alias("share")).where("share > 0.9").select("day")
    return d.join(halts, "day", "left_anti").where("volume = 0").groupBy("ticker").agg(F.count("*").alias("empty_days"))


@query(BARS + """, g AS (SELECT ticker, ts, floor(close / 40) AS q, lag(floor(close / 40)) OVER (PARTITION BY ticker ORDER BY ts) AS before FROM bars),
n AS (SELECT count(DISTINCT ticker) AS n FROM bars)
SELECT ts, round(count(*) FILTER (WHERE q = before) / any_value(n.n), 6) AS share FROM g, n GROUP BY ts HAVING count(*) FILTER (WHERE q = before) / any_value(n.n) >= 0.3""")
def dq_freeze(spark, sf_dir):
    """Times at which a good part of all tickers stands still."""
    g = hourly_bars(spark, sf_dir).withColumn("q", F.floor(F.col("close") / 40))
    g = g.withColumn("still", F.col("q") == F.lag("q").over(W.over(["ticker"], ["ts"])))
    n = g.select(F.count_distinct("ticker").alias("n"))
    by = g.groupBy("ts").agg(F.count_if("still").alias("k")).join(F.broadcast(n))
    return by.select("ts", F.round(F.col("k") / F.col("n"), 6).alias("share"), (F.col("k") / F.col("n")).alias("raw")).where("raw >= 0.3").drop("raw")


@query(BARS + """, s AS (SELECT ticker, median(value) AS mid, avg(value * volume) AS turnover, count(*) AS days, avg(CASE WHEN volume < 10 THEN 1.0 ELSE 0 END) AS thin FROM daily GROUP BY 1),
m AS (SELECT max(days) AS most FROM s)
SELECT ticker, CASE WHEN mid < 15 THEN 'price' WHEN turnover < 1500 THEN 'turnover' WHEN days < 0.6 * most THEN 'coverage' WHEN thin >= 0.1 THEN 'thin' ELSE 'kept' END AS outcome FROM s, m""")
def universe_screens(spark, sf_dir):
    """The first rule each ticker fails, or 'kept'."""
    s = daily_panel(spark, sf_dir).groupBy("ticker").agg(
        F.median("value").alias("mid"), F.avg(F.col("value") * F.col("volume")).alias("turnover"), F.count("*").alias("days"),
        F.avg((F.col("volume") < 10).cast("double")).alias("thin"),
    )
    s = s.join(F.broadcast(s.agg(F.max("days").alias("most"))))
    outcome = (
        F.when(F.col("mid") < 15, "price").when(F.col("turnover") < 1500, "turnover").when(F.col("days") < 0.6 * F.col("most"), "coverage")
        .when(F.col("thin") >= 0.1, "thin").otherwise("kept")
    )
    return s.select("ticker", outcome.alias("outcome"))


@query(BARS + """SELECT ticker, ts, round(CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 3600 THEN r END, 6) AS r FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts)""")
def log_returns(spark, sf_dir):
    """Logarithmic returns, null across gaps of more than an hour."""
    w = W.over(["ticker"], ["ts"])
    return hourly_bars(spark, sf_dir).select("ticker", "ts", F.round(W.log_return("close", w, "ts", 3600), 6).alias("r"))


@query(BARS + """SELECT ticker, ts, round(CASE WHEN count(close) OVER w >= 12 THEN (close - avg(close) OVER w) / greatest(stddev_samp(close) OVER w, 1e-10) END, 6) AS z
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_zscore(spark, sf_dir):
    """Rolling z-score of 24 bars, from 12 values on."""
    z = W.zscore(F.col("close"), W.over(["ticker"], ["ts"], (-23, 0)), 12)
    return hourly_bars(spark, sf_dir).select("ticker", "ts", F.round(z, 6).alias("z"))


@query(BARS + """SELECT ticker, ts, CASE WHEN row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) > 3 THEN close END AS warm FROM bars""")
def session_warmup(spark, sf_dir):
    """Closes, null for the first three bars of a day."""
    b = hourly_bars(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return b.select("ticker", "ts", F.when(F.row_number().over(W.over(["ticker", "day"], ["ts"])) > 3, F.col("close")).alias("warm"))


@query(BARS + """, f AS (SELECT ticker, avg(close) AS mu, stddev_pop(close) AS sd FROM bars WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT b.ticker, b.ts, round((close - mu) / greatest(sd, 1e-10), 6) AS z FROM bars b JOIN f ON f.ticker = b.ticker WHERE b.ts >= TIMESTAMP '2024-01-16'""")
def locked_zscore(spark, sf_dir):
    """Z-score by the mean and population deviation of a formation period."""
    b, cut = hourly_bars(spark, sf_dir), F.lit("2024-01-16").cast("timestamp_ntz")
    form = b.where(F.col("ts") < cut).groupBy("ticker").agg(F.avg("close").alias("mu"), F.stddev_pop("close").alias("sd"))
    z = (F.col("close") - F.col("mu")) / F.greatest("sd", F.lit(W.FLOOR))
    return b.where(F.col("ts") >= cut).join(form, "ticker").select("ticker", "ts", F.round(z, 6).alias("z"))


@query(BARS + """, s AS (SELECT *, row_number() OVER (PARTITION BY ticker, ts < TIMESTAMP '2024-01-16' ORDER BY ts DESC) AS back FROM bars),
t AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-16' OR back <= 24),
z AS (SELECT ticker, ts, CASE WHEN count(close) OVER w >= 24 THEN (close - avg(close) OVER w) / greatest(stddev_samp(close) OVER w, 1e-10) END AS z
  FROM t WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT ticker, ts, round(z, 6) AS z FROM z WHERE ts >= TIMESTAMP '2024-01-16'""")
def seeded_zscore(spark, sf_dir):
    """Rolling z-score of a trading period, started from the tail of the formation period."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    b = hourly_bars(spark, sf_dir).withColumn("old", F.col("ts") < cut)
    back = F.row_number().over(W.over(["ticker", "old"], [F.desc("ts")]))
    t = b.withColumn("back", back).where(~F.col("old") | (F.col("back") <= 24))
    z = W.zscore(F.col("close"), W.over(["ticker"], ["ts"], (-23, 0)), 24)
    return t.withColumn("z", F.round(z, 6)).where(~F.col("old")).select("ticker", "ts", "z")


@query(BARS + """, x AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i,
  avg(close) OVER e AS em, stddev_samp(close) OVER e AS es, count(close) OVER e AS en, avg(close) OVER t AS tm, stddev_samp(close) OVER t AS tsd FROM bars
  WINDOW e AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT ticker, ts, round(CASE WHEN en < 20 THEN NULL WHEN (CASE WHEN i <= 50 THEN es ELSE tsd END) <= 1e-12 THEN 0
  ELSE (close - CASE WHEN i <= 50 THEN em ELSE tm END) / (CASE WHEN i <= 50 THEN es ELSE tsd END) END, 6) AS z FROM x""")
def trailing_zscore(spark, sf_dir):
    """Z-score by what came before: all of it up to bar 50, then the last 100 bars; the current one never counts."""
    everything, tail = W.over(["ticker"], ["ts"], (Window.unboundedPreceding, -1)), W.over(["ticker"], ["ts"], (-100, -1))
    c, i = F.col("close"), F.row_number().over(W.over(["ticker"], ["ts"]))
    x = hourly_bars(spark, sf_dir).withColumns({
        "n": F.count(c).over(everything), "m": F.when(i <= 50, F.avg(c).over(everything)).otherwise(F.avg(c).over(tail)),
        "s": F.when(i <= 50, F.stddev_samp(c).over(everything)).otherwise(F.stddev_samp(c).over(tail)),
    })
    z = F.when(F.col("n") < 20, None).when(F.col("s") <= 1e-12, 0).otherwise((c - F.col("m")) / F.col("s"))
    return x.select("ticker", "ts", F.round(z, 6).alias("z"))


@query(BARS + """, d AS (SELECT ticker, CAST(ts AS DATE) AS day, max(high) - min(low) AS span FROM bars GROUP BY 1, 2),
q AS (SELECT *, count(span) OVER w AS n, quantile_cont(span, 0.67) OVER w AS q67, quantile_cont(span, 0.85) OVER w AS q85 FROM d WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, day, CASE WHEN n < 5 THEN NULL WHEN span > q85 THEN 0.0 WHEN span > q67 THEN 0.5 ELSE 1.0 END AS size FROM q""")
def trailing_quantile(spark, sf_dir):
    """Size by where a day's span lies among the quantiles of the days before."""
    d = hourly_bars(spark, sf_dir).groupBy("ticker", F.to_date("ts").alias("day")).agg((F.max("high") - F.min("low")).alias("span"))
    w = W.over(["ticker"], ["day"], (-20, -1))
    q = d.withColumns({"n": F.count("span").over(w), "q67": F.percentile("span", 0.67).over(w), "q85": F.percentile("span", 0.85).over(w)})
    size = F.when(F.col("n") < 5, None).when(F.col("span") > F.col("q85"), 0.0).when(F.col("span") > F.col("q67"), 0.5).otherwise(1.0)
    return q.select("ticker", "day", size.alias("size"))


@query(BARS + """SELECT ticker, ts, round(CASE WHEN count(r) OVER a >= 6 THEN sum(r) OVER a END, 6) AS sum_12, round(CASE WHEN count(r) OVER b >= 24 THEN stddev_samp(r) OVER b END, 6) AS dev_24,
round(close / max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM rets
WINDOW a AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, sf_dir):
    """Rolling sum and deviation of returns, drawdown from the running maximum."""
    x, r = returns(spark, sf_dir), F.col("r")
    a, b = W.over(["ticker"], ["ts"], (-11, 0)), W.over(["ticker"], ["ts"], (-23, 0))
    return x.withColumns({"sum_12": W.rolling(F.sum, r, a, 6), "dev_24": W.rolling(F.stddev_samp, r, b, 24), "drawdown": W.drawdown("close", ["ticker"], ["ts"])}).select(
        "ticker", "ts", *r6("sum_12", "dev_24", "drawdown")
    )


@query(BARS + """, e AS (SELECT ticker, ts, exp(sum(ln(1 + greatest(coalesce(r / 100, 0), -1 + 1e-9))) OVER w) AS equity FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT ticker, round(last(equity ORDER BY ts), 6) AS final, round(min(dd), 6) AS max_drawdown FROM d GROUP BY 1""")
def equity_curve(spark, sf_dir):
    """Compounded equity and its largest drawdown."""
    x = returns(spark, sf_dir).withColumn("equity", W.compounded(F.col("r") / 100, ["ticker"], ["ts"]))
    x = x.withColumn("dd", W.drawdown("equity", ["ticker"], ["ts"]))
    return x.groupBy("ticker").agg(F.round(F.max_by("equity", "ts"), 6).alias("final"), F.round(F.min("dd"), 6).alias("max_drawdown"))


@query(BARS + """, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM bars)
SELECT ticker, round(regr_slope(close, -back), 6) AS slope, round(regr_slope(close, -back) * 30 / stddev_samp(close), 6) AS normalised FROM t WHERE back <= 30 GROUP BY 1""")
def trend_slope(spark, sf_dir):
    """Linear trend of the last 30 bars, also in deviations over that length."""
    t = hourly_bars(spark, sf_dir).withColumn("back", F.row_number().over(W.over(["ticker"], [F.desc("ts")]))).where("back <= 30")
    slope = W.slope("close", -F.col("back"))
    return t.groupBy("ticker").agg(F.round(slope, 6).alias("slope"), F.round(F.try_divide(slope * 30, F.stddev_samp("close")), 6).alias("normalised"))


@query(BARS + """, s AS (SELECT ticker, CAST(ts AS DATE) AS day, ts, CASE WHEN volume < 60 THEN NULL ELSE close END AS c FROM bars),
f AS (SELECT *, CASE WHEN (c IS NULL) = (lag(c) OVER w IS NULL) AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts) AS run FROM f)
SELECT ticker, min(ts) AS halted_from, max(ts) AS halted_to, count(*) AS bars FROM i WHERE c IS NULL GROUP BY ticker, run HAVING count(*) >= 3""")
def halt_periods(spark, sf_dir):
    """Runs of at least three missing values."""
    s = hourly_bars(spark, sf_dir).withColumn("gone", F.col("volume") < 60)
    runs = W.runs(s, ["ticker"], ["ts"], F.col("gone")).where("gone").groupBy("ticker", "run")
    return runs.agg(F.min("ts").alias("halted_from"), F.max("ts").alias("halted_to"), F.count("*").alias("bars")).where("bars >= 3").drop("run")


@query(BARS + """, l AS (SELECT unnest(generate_series(2, 20)) AS lag), x AS (SELECT ticker, i, close FROM rets),
d AS (SELECT a.ticker, l.lag, stddev_pop(b.close - a.close) AS s FROM x a CROSS JOIN l JOIN x b ON b.ticker = a.ticker AND b.i = a.i + l.lag GROUP BY 1, 2)
SELECT ticker, round(regr_slope(ln(s), ln(lag)), 6) AS hurst FROM d WHERE s > 0 GROUP BY 1""")
def hurst(spark, sf_dir):
    """Hurst exponent: log-log slope of the deviation of lagged differences, lags 2 to 20."""
    w = W.over(["ticker"], ["ts"])
    b = hourly_bars(spark, sf_dir)
    lags = b.select("ticker", *[(F.lead("close", k).over(w) - F.col("close")).alias(f"d{k}") for k in range(2, 21)])
    wide = lags.groupBy("ticker").agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.stddev_pop(f"d{k}").alias("s")) for k in range(2, 21)]).alias("a"))
    return wide.select("ticker", F.explode("a").alias("x")).where("x.s > 0").groupBy("ticker").agg(F.round(W.slope(F.ln("x.s"), F.ln("x.lag")), 6).alias("hurst"))


@query(BARS + """, l AS (SELECT unnest(generate_series(2, 99)) AS lag), x AS (SELECT ticker, i, close, count(*) OVER (PARTITION BY ticker) AS n FROM rets),
d AS (SELECT a.ticker, l.lag, any_value(a.n) AS n, stddev_samp(b.close - a.close) AS s FROM x a JOIN l ON l.lag < a.n // 2 JOIN x b ON b.ticker = a.ticker AND b.i = a.i + l.lag GROUP BY 1, 2)
SELECT ticker, CASE WHEN any_value(n) >= 110 AND min(s) > 0 THEN round(regr_slope(ln(CASE WHEN s > 0 THEN s END), ln(lag)), 6) END AS hurst FROM d GROUP BY 1""")
def hurst_long(spark, sf_dir):
    """Hurst exponent over lags 2 to min(100, n / 2) - 1 of each series; null for under 110 bars or a lag without deviation."""
    w, lags = W.over(["ticker"], ["ts"]), range(2, 100)
    b = hourly_bars(spark, sf_dir)
    d = b.select("ticker", *[(F.lead("close", k).over(w) - F.col("close")).alias(f"d{k}") for k in lags])
    wide = d.groupBy("ticker").agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(k).alias("lag"), F.stddev_samp(f"d{k}").alias("s")) for k in lags]).alias("a"))
    x = wide.select("ticker", "n", F.explode("a").alias("x")).where("x.lag < n div 2")
    slope = F.when((F.first("n") >= 110) & (F.min("x.s") > 0), W.slope(F.when(F.col("x.s") > 0, F.ln("x.s")), F.ln("x.lag")))
    return x.groupBy("ticker").agg(F.round(slope, 6).alias("hurst"))


@query(BARS + """SELECT ticker, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS dev, round(skewness(r), 5) AS skew, round(kurtosis(r), 5) AS kurt,
round(quantile_cont(r, 0.05), 6) AS q05, round(quantile_cont(r, 0.99), 6) AS q99, round(avg(CASE WHEN abs(r) > 1 THEN 1.0 ELSE 0 END), 6) AS tail FROM rets WHERE r IS NOT NULL GROUP BY 1""")
def tail_stats(spark, sf_dir):
    """Moments (bias-corrected), quantiles and tail share of returns."""
    x, n = returns(spark, sf_dir).where("r is not null"), F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis("r") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return x.groupBy("ticker").agg(
        F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r"), 6).alias("dev"), F.round(skew, 5).alias("skew"),
        F.round(kurt, 5).alias("kurt"), F.round(F.percentile("r", 0.05), 6).alias("q05"), F.round(F.percentile("r", 0.99), 6).alias("q99"),
        F.round(F.avg((F.abs("r") > 1).cast("double")), 6).alias("tail"),
    )
