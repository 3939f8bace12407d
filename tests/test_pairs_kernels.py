"""Pair statistics and kernels against NumPy and by property."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import kernels as K
from tidemark.operators import pairs as P


def johansen(a, b):
    x = np.column_stack([a, b])
    d = np.diff(x, axis=0)
    y, lag, level = d[1:], d[:-1], x[1:-1]
    y, lag, level = (m - m.mean(0) for m in (y, lag, level))
    fit = lambda m: m - lag @ np.linalg.lstsq(lag, m, rcond=None)[0]
    r0, r1 = fit(y), fit(level)
    n = len(y)
    s00, s11, s10 = r0.T @ r0 / n, r1.T @ r1 / n, r1.T @ r0 / n
    ev = np.linalg.eigvals(np.linalg.solve(s11, s10) @ np.linalg.solve(s00, s10.T)).real
    return -n * np.log(1 - ev).sum()


def test_johansen_trace_is_the_textbook_one(spark):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(0.01, 1, 400))
    series = {"tied": (walk + rng.normal(0, 0.5, 400), walk), "free": (np.cumsum(rng.normal(0, 1, 400)), walk), "flat": (np.ones(400), walk)}
    rows = [(k, i, float(a[i]), float(b[i])) for k, (a, b) in series.items() for i in range(400)] + [("short", i, 1.0 * i, 2.0) for i in range(5)]
    got = {r["k"]: r for r in P.johansen_trace(spark.createDataFrame(rows, "k string, ts int, a double, b double"), ["k"]).collect()}
    for k in ("tied", "free"):
        assert got[k]["trace"] == pytest.approx(johansen(*series[k]), rel=1e-8)
    assert got["tied"]["p_value"] < 1e-6 < got["free"]["p_value"]
    assert got["flat"]["trace"] is None and got["short"]["trace"] is None


def test_principal_hedge_ratio(spark):
    rng = np.random.default_rng(2)
    b = rng.normal(0, 1, 300)
    a = 0.7 * b + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([("p", float(x), float(y)) for x, y in zip(a, b)], "k string, a double, b double")
    got = P.pair_statistics(df, ["k"]).head()
    v = np.linalg.eigh(np.cov(a, b))[1][:, 0]
    assert got["beta_pca"] == pytest.approx(-v[1] / v[0], rel=1e-9)
    assert got["noise"] == pytest.approx(np.var(a - got["beta_pca"] * b, ddof=1), rel=1e-9)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.04]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "f int, i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in P.benjamini_hochberg(df, ["f"], "p", "i").collect()}
    assert [got[i] for i in range(6)] == pytest.approx([0.03, 0.048, 0.048, 0.03, 1.0, 0.048])


def test_ticker_cap(spark):
    rows = [(1, "A", "B", 0.1), (1, "A", "C", 0.2), (1, "B", "C", 0.3), (1, "A", "D", 0.4), (2, "A", "B", 0.5)]
    df = spark.createDataFrame(rows, "fold int, ticker_a string, ticker_b string, p double")
    assert {tuple(r)[:3] for r in P.ticker_cap(df, "fold", ["p"], 1).collect()} == {(1, "A", "B"), (2, "A", "B")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-4, 4)), max_size=60))
def test_position_invariants(z):
    z = np.array([np.nan if v is None else v for v in z])
    held, code = K.positions(z, 2.0, 0.5, 3.0)
    before = np.append(0, held[:-1])
    assert not (held * before == -1).any()  # never turns without being flat
    assert ((code > 0) == ((before != 0) & (held == 0))).all()
    assert (held[np.isnan(z)] == before[np.isnan(z)]).all()
    cut = len(z) // 2
    assert (K.positions(z[:cut], 2.0, 0.5, 3.0)[0] == held[:cut]).all()  # what follows changes nothing


def test_positions_by_hand():
    z = np.array([0, -2.1, -1, np.nan, -0.4, 2.2, 0.3, 2.5, -2.5, -2.5])
    assert K.positions(z, 2.0, 0.5)[0].tolist() == [0, 1, 1, 1, 0, -1, 0, -1, 0, 1]


def test_kalman_follows_a_shift_and_guards_hold():
    rng = np.random.default_rng(0)
    b = rng.normal(3, 0.2, 600)
    a = 1 + np.where(np.arange(600) < 300, 0.5, 0.9) * b + rng.normal(0, 0.01, 600)
    spread, _, beta = K.kalman(a, b, 1e-3, 1e-4)
    assert (K.kalman(a[:50], b[:50], 1e-3, 1e-4)[0] == spread[:50]).all()  # what follows changes nothing
    assert abs(beta[-1] * 3 - 0.9 * 3) < 1.5 and np.abs(spread[-100:]).mean() < 0.05
    a[100] = np.nan
    s2, _, b2 = K.kalman(a, b, 1e-3, 1e-4, clamp=(0.0, 0.6))
    assert np.isnan(s2[100]) and b2.max() <= 0.6
    with pytest.raises(ValueError):
        K.kalman(a, b, 1e-3, 0)


@pytest.mark.parametrize("gate,clamp", [(None, None), (2.0, (0.5, 1.1))])
def test_kalman_is_the_matrix_form(gate, clamp):
    rng = np.random.default_rng(5)
    b = np.cumsum(rng.normal(0, 0.01, 400))
    a = 0.3 + 1.2 * b + rng.normal(0, 0.05, 400)
    a[50], a[90] = np.nan, a[90] + 2
    theta, p = np.array([0.0, 1.0]), np.eye(2) * 0.01
    for i, got in enumerate(zip(*K.kalman(a, b, 1e-3, 0.01, gate, clamp))):
        p, h, miss = p + np.eye(2) * 1e-5, np.array([1.0, b[i]]), np.nan
        if not np.isnan(a[i]):
            miss, s = a[i] - h @ theta, h @ p @ h + 0.01
            if gate is None or miss**2 <= gate**2 * s:
                k = p @ h / s
                theta = theta + k * miss
                theta[1] = np.clip(theta[1], *(clamp or (-np.inf, np.inf)))
                p = (np.eye(2) - np.outer(k, h)) @ p @ (np.eye(2) - np.outer(k, h)).T + np.outer(k, k) * 0.01
        assert np.allclose(got, [miss, *theta], atol=1e-12, equal_nan=True)


def test_change_points():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, 40), rng.normal(3, 0.1, 30), rng.normal(0, 0.1, 30)])
    assert K.change_points(x, 2.0, 3) == [40, 70]
    assert K.change_points(np.zeros(20), 1.0, 2) == []


def test_change_points_are_the_best_segmentation():
    """Against all segmentations by dynamic programming over the full kernel matrix, without pruning."""
    rng = np.random.default_rng(2)
    for k in range(8):
        x = np.concatenate([rng.normal(m, 1, (12, 2)) for m in rng.integers(0, 6, 3)])
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        assert K.median_squared_distance(x, 5, 20) == pytest.approx(np.median(d[np.triu_indices(len(x), 1)]))
        g = np.exp(-np.clip(d / np.median(d[np.triu_indices(len(x), 1)]), 1e-2, 1e2))
        cost = lambda a, b: np.trace(g[a:b, a:b]) - g[a:b, a:b].sum() / (b - a)
        best, back = [-1.0], [0]
        for end in range(1, len(x) + 1):
            costs = [best[a] + cost(a, end) + 1.0 if end - a >= 2 else np.inf for a in range(end)]
            best.append(min(costs))
            back.append(int(np.argmin(costs)))
        at, wanted = len(x), []
        while back[at]:
            at = back[at]
            wanted.append(at)
        assert K.change_points(x, 1.0, 2) == wanted[::-1]


def test_rebalances():
    beta = np.array([1.0, 1.02, 1.2, 1.21, 1.5, 2.0, 2.0])
    held = np.array([1, 1, 1, 1, 0, 1, 1])
    assert K.rebalances(beta, held, 0.1).tolist() == [False, False, True, False, False, False, False]


def test_half_life(spark):
    rng = np.random.default_rng(9)
    s = np.zeros(3000)
    for i in range(1, 3000):
        s[i] = 0.9 * s[i - 1] + rng.normal()
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(s)] + [("up", i, float(i * i)) for i in range(20)], "k string, ts int, spread double")
    got = {r["k"]: r["half_life"] for r in P.half_life(df, ["k"], "ts").collect()}
    assert got["a"] == pytest.approx(math.log(2) / 0.1, rel=0.25) and got["up"] is None


def test_series_keep_their_columns(spark):
    df = spark.createDataFrame([("a", 1, 3.0, "x"), ("a", 2, None, "y"), (None, 1, -3.0, "z")], "k string, i int, z double, `odd name` string")
    got = K.with_positions(df, ["k"], ["i"], "z", 2.0, 0.5).toPandas()
    assert isinstance(got, pd.DataFrame) and len(got) == 3 and set(got["position"]) == {-1, 1}
