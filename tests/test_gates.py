"""Splits, gates and tests on made cases."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates as G


def test_periods_must_not_overlap(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-20",), (None,)], "d string").withColumn("day", F.to_date("d"))
    form, trade = G.split_periods(df, "day", ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-02-01"))
    assert (form.count(), trade.count()) == (1, 1)
    with pytest.raises(ValueError):
        G.split_periods(df, "day", ("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-02-01"))


def test_correlation_gate(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, loads in {"kept": (0.9, 0.9, 0.95), "decay": (0.95, 0.6, 0.3), "floor": (0.9, 0.9, -0.5)}.items():
        for k, c in enumerate(loads):
            b = rng.normal(size=400)
            a = c * b + math.sqrt(1 - c * c) * rng.normal(size=400)
            rows += [(name, 400 * k + i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    rows += [("missing", i, 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double")
    got = G.correlation_gate(df, ["k"], "t", [F.lit(400), F.lit(800)], 0.15, 0.15).collect()
    assert {r["k"]: r["gate"] for r in got} == {k: k for k in ("kept", "decay", "floor", "missing")}


def test_dickey_fuller_tells_a_walk_from_a_stationary_series():
    rng = np.random.default_rng(2)
    e = rng.normal(size=800)
    ar = np.zeros(800)
    for i in range(1, 800):
        ar[i] = 0.7 * ar[i - 1] + e[i]
    assert G.adf_statistic(ar, 8)[0] < -8 < -3 < G.adf_statistic(np.cumsum(e), 8)[0]
    t, lags = G.adf_statistic(ar, 0)
    y, x = np.diff(ar), ar[:-1]
    beta = x @ y / (x @ x)
    se = math.sqrt(((y - beta * x) ** 2).sum() / (len(y) - 1) / (x @ x))
    assert lags == 0 and t == pytest.approx(beta / se)


def test_engle_granger(spark):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(size=500))
    rows = [("tied", i, float(a), float(b)) for i, (a, b) in enumerate(zip(2 * walk + rng.normal(size=500), walk))]
    rows += [("free", i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.cumsum(rng.normal(size=500)), walk))]
    rows += [("short", i, float(i), 1.0) for i in range(5)]
    got = {r["k"]: r["cointegrated"] for r in G.engle_granger(spark.createDataFrame(rows, "k string, t int, a double, b double"), ["k"], "t").collect()}
    assert got == {"tied": True, "free": False, "short": None}


def test_engle_granger_looks_at_thirty_lags(spark):
    rng = np.random.default_rng(5)
    walk, rest = np.cumsum(rng.normal(size=900)), np.zeros(900)
    for i in range(900):
        rest[i] = (0.8 * rest[i - 15] if i >= 15 else 0) + rng.normal()
    rows = [("long", i, float(a), float(b)) for i, (a, b) in enumerate(zip(2 * walk + rest, walk))]
    got = G.engle_granger(spark.createDataFrame(rows, "k string, t int, a double, b double"), ["k"], "t").head()
    assert 14 <= got["lags"] <= 30


def test_deflated_ratio(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k}", float(v)) for k in range(8) for v in rng.normal(0.4 if k == 0 else 0.0, 1, 200)] + [("few", 1.0), ("flat", 1.0), ("flat", 1.0), ("flat", 1.0), ("gone", None)]
    got = {r["k"]: r for r in G.deflated_ratio(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["s0"]["deflated"] > 0.9 > 0.5 > got["s1"]["deflated"]
    assert got["few"]["deflated"] is None and got["flat"]["deflated"] is None and got["gone"]["n"] == 0
    assert 0 <= got["s2"]["deflated"] <= NormalDist().cdf(10)
