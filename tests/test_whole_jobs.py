"""Queries that do the whole of what the survey lists, against NumPy."""

import math
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans.relations import bootstrap_draws, residual_prices
from tidemark.sources.market import daily_panel, hourly_bars


def test_draws_are_with_replacement(spark):
    for n in (30, 31):
        g = bootstrap_draws(n, 1000, 42, spark).toPandas()
        assert len(g) == 1000 * n and g["i"].between(0, n - 1).all()
        distinct = g.groupby("b")["i"].nunique()
        mean = n * (1 - (1 - 1 / n) ** n)
        var = n * (1 - 1 / n) ** n + n * (n - 1) * (1 - 2 / n) ** n - n**2 * (1 - 1 / n) ** (2 * n)
        assert abs(distinct.mean() - mean) < 5 * math.sqrt(var / 1000)
        assert distinct.std() == pytest.approx(math.sqrt(var), rel=0.15)
        assert g["i"].value_counts().between(800, 1200).all()
    assert bootstrap_draws(0, 10, 42, spark).count() == 0


def test_bootstrap_sharpe(spark, sf):
    got = entry.queries()["bootstrap_sharpe"](spark, sf).head()
    r = daily_panel(spark, sf).toPandas().groupby("ts")["value"].mean().to_numpy()
    x = np.random.default_rng(1).choice(r, (20_000, len(r)))
    s = x.mean(1) / x.std(1, ddof=1) * math.sqrt(252)
    assert got["draws"] == 1000
    assert got["mean"] == pytest.approx(s.mean(), abs=5 * s.std() / math.sqrt(1000))
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(np.quantile(s, [0.025, 0.975])), abs=0.3 * s.std())


def check_residuals(got, panel, k):
    """Against SVD of the complete tickers' panel."""
    wide = np.log(panel[panel["value"] > 0].pivot(index="ts", columns="ticker", values="value").reindex(sorted(panel["ts"].unique()))).dropna(axis=1)
    r = np.diff(wide.to_numpy(), axis=0)
    _, sv, v = np.linalg.svd(r - r.mean(0), full_matrices=False)
    rest = r - r @ v[:k].T @ v[:k]
    prices = np.vstack([wide.to_numpy()[:1], wide.to_numpy()[0] + np.cumsum(rest, axis=0)])
    assert got["explained"].iloc[0] == pytest.approx((sv[:k] ** 2).sum() / (sv**2).sum(), abs=1e-5)
    for column, wanted in (("residual", np.vstack([np.full((1, r.shape[1]), np.nan), rest])), ("residual_log_price", prices)):
        have = got.pivot(index="ts", columns="ticker", values=column).reindex(index=wide.index, columns=wide.columns)
        np.testing.assert_allclose(have.to_numpy(float), wanted, atol=2e-5)
    assert len(got) == wide.size
    return wide.shape[1]


def test_residual_prices(spark):
    rng = np.random.default_rng(6)
    x = np.exp(np.cumsum(rng.normal(0.01, 0.1, (40, 3)) @ rng.normal(size=(3, 12)) + rng.normal(0, 0.05, (40, 12)), axis=0))
    rows = [(k, i, float(x[i, k])) for k in range(12) for i in range(40) if (k, i) != (3, 0)] + [(20, i, -1.0 if i == 5 else 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker bigint, ts int, value double")
    panel = pd.DataFrame(rows, columns=["ticker", "ts", "value"])
    assert check_residuals(residual_prices(df, 5, 6, 7).toPandas(), panel, 5) == 11
    assert residual_prices(df).count() == residual_prices(df, 5, 12, 7).count() == residual_prices(df.limit(0), 5, 6, 7).count() == 0


def test_residuals_of_more_tickers_than_days(spark, monkeypatch):
    """What the driver receives grows with the days, not with the tickers."""
    kind, seen = type(spark.range(1)), []
    for name in ("collect", "toPandas", "toArrow"):
        plain = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, plain=plain: (got := plain(self), seen.append(len(got)))[0])
    x = np.exp(np.cumsum(np.random.default_rng(12).normal(0.01, 0.1, (9, 120)), axis=0))
    rows = [(k, i, float(v)) for (i, k), v in np.ndenumerate(x)]
    out = residual_prices(spark.createDataFrame(rows, "ticker bigint, ts int, value double"), 5, 6, 7)
    assert sum(seen) < 50
    assert check_residuals(out.toPandas(), pd.DataFrame(rows, columns=["ticker", "ts", "value"]), 5) == 120


def test_factor_residuals_are_the_users(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    got = entry.queries()["factor_residuals"](spark, sf).toPandas()
    assert check_residuals(got, daily_panel(spark, sf).toPandas(), 5) > 5


def test_hurst_over_all_lags(spark, sf):
    got = {r["ticker"]: r["hurst"] for r in entry.queries()["hurst_long"](spark, sf).collect()}
    for ticker, bars in hourly_bars(spark, sf).toPandas().groupby("ticker"):
        x = bars.sort_values("ts")["close"].to_numpy()
        lags = np.arange(2, min(100, len(x) // 2))
        wanted = np.polyfit(np.log(lags), np.log([np.std(x[k:] - x[:-k], ddof=1) for k in lags]), 1)[0] if len(x) >= 110 else None
        assert got[ticker] == (pytest.approx(wanted, abs=2e-6) if wanted is not None else None)
