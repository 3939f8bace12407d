"""Block gates, replayed exits, quantiles and resampling against plain versions of their rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import kernels as K
from tidemark.operators.windows import running_total
from tidemark.plans.validation import paired_difference, projected_residuals
from tests.test_pairs_kernels import johansen


def frame(spark, pairs):
    rows = [(k, int(i), int(b), float(x), float(y)) for k, (blocks, a, c) in pairs.items() for i, (b, x, y) in enumerate(zip(blocks, a, c))]
    return spark.createDataFrame(rows, "pair string, ts int, block int, a double, b double")


def pca(a, b):
    c = np.cov(a, b)
    v = np.linalg.eigh(c)[1][:, 0]
    return -v[1] / v[0] if abs(v[0]) > 1e-12 else np.nan


def days(s, per_day):
    d, l = np.diff(s), s[:-1]
    kappa = np.cov(d, l)[0, 1] / np.var(l, ddof=1)
    return -math.log(2) / kappa / per_day if kappa < 0 else np.nan


def p_value(a, b):
    h = johansen(a, b) / 2
    return math.exp(-h) * (1 + h + h * h / 2 + h**3 / 6)


def temporal(blocks, a, b, per_day):
    beta = pca(a, b)
    spread = a - (a.mean() - beta * b.mean()) - beta * b
    parts = [(a[blocks == k], b[blocks == k], spread[blocks == k]) for k in (1, 2, 3)]
    if any(len(x) < 40 for x, _, _ in parts):
        return "missing"
    if max(abs(pca(x, y) - beta) / (abs(beta) + 1e-10) for x, y, _ in parts) > 0.3:
        return "drift"
    means = [s.mean() for _, _, s in parts]
    if max(abs(np.diff(means))) / spread.std(ddof=1) > 1:
        return "shift"
    if sum(p_value(x, y) < 0.05 for x, y, _ in parts) < 2:
        return "cointegration"
    return "kept" if all(1 <= days(s, per_day) <= 10 for _, _, s in parts) else "half-life"


def made(rng, n, phi, noise=0.01, drift=0.0, jump=0.0):
    b = np.cumsum(rng.normal(0, 0.02, n))
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = phi * e[i - 1] + rng.normal(0, noise)
    blocks = 1 + np.arange(n) * 3 // n
    return blocks, 0.2 + (1.1 + drift * (blocks - 1)) * b + e + jump * (blocks == 3), b


def test_block_gates(spark):
    rng = np.random.default_rng(6)
    pairs = {f"p{k}": made(rng, int(rng.choice([90, 240, 300])), rng.choice([0.5, 0.8, 0.95, 1.0]), drift=rng.choice([0, 0, 0.6]), jump=rng.choice([0, 0, 0.3])) for k in range(40)}
    got = {r["pair"]: r["gate"] for r in G.temporal_gate(frame(spark, pairs), ["pair"], "ts", 3, bars_per_day=1.0).collect()}
    assert got == {k: temporal(*v, 1.0) for k, v in pairs.items()}
    assert len(set(got.values())) >= 4
    two = {k: (np.minimum(v[0], 2), *v[1:]) for k, v in pairs.items()} | {"short": (np.array([1] * 50 + [2] * 10), rng.normal(size=60), rng.normal(size=60))}
    got = {r["pair"]: r["gate"] for r in G.valid_gate(frame(spark, two), ["pair"], "ts").collect()}

    def valid(blocks, a, b):
        if min((blocks == 1).sum(), (blocks == 2).sum()) < 20:
            return "missing"
        p = [p_value(a[blocks == k], b[blocks == k]) for k in (1, 2)]
        return "formation" if p[0] >= 0.05 else "validation" if p[1] >= 0.05 else "kept"

    assert got == {k: valid(*v) for k, v in two.items()}


def test_replay():
    nan = np.nan
    z = np.array([0, -2, -2, -1, 0, 0, -2, nan, -1, 0.0])
    plain = K.replay(z, 1.5, 0.2)
    assert plain[0].tolist() == K.positions(z, 1.5, 0.2)[0].tolist() and plain[1].tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    corr = np.array([1, 1, -1, 1, 1, 1, 1, 1, 1, 1.0])
    held, code = K.replay(z, 1.5, 0.2, corr=corr, floor=-0.5)  # blocked until the signal was flat at bar 4
    assert held.tolist() == [0, 1, 0, 0, 0, 0, 1, 1, 1, 0] and code.tolist() == [0, 0, 2, 0, 0, 0, 0, 0, 0, 1]
    spread, mean, dev = np.zeros(10), np.array([0, 0, -3, 0, 0, 0, 0, 0, 0, 0.0]), np.ones(10)
    held, code = K.replay(z, 1.5, 0.2, spread=spread, mean=mean, dev=dev, moved=2.0)  # not blocked: back in at bar 3
    assert held.tolist() == [0, 1, 0, 1, 0, 0, 1, 1, 1, 0] and code.tolist() == [0, 0, 3, 0, 1, 0, 0, 0, 0, 1]
    held, _ = K.replay(np.array([-1, -2, -2.5, -2.2, 0]), 1.5, 0.2, confirm=True)
    assert held.tolist() == [0, 0, 0, 1, 0]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_quantiles_and_running_totals(spark, partitions):
    rng = np.random.default_rng(partitions)
    data = {"a": rng.normal(size=101), "b": np.repeat([1.0, 2.0, 5.0], [50, 1, 3]), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("c", float("nan")), (None, 3.0)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "k string, v double")
        got = {r["k"]: (r["n"], r["quantiles"]) for r in G.exact_quantiles(df, "k", "v", [0.0, 0.25, 0.5, 0.99]).collect()}
        one = df.where("k = 'a' and v is not null").withColumn("w", F.lit(2))
        total = {r["v"]: r["t"] for r in running_total(one, [], "v", "w", "t").collect()}
        none = G.exact_quantiles(df.limit(0), "k", "v", [0.5]).count(), G.auroc(df.limit(0).withColumn("p", F.lit(True)), "p", "v").collect()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got.pop(None) == (1, [3.0] * 4)
    assert {k: n for k, (n, _) in got.items()} == {k: len(x) for k, x in data.items()}
    for k, (_, q) in got.items():
        assert np.allclose(q, np.quantile(data[k], [0.0, 0.25, 0.5, 0.99]))
    assert total == {v: 2 * (i + 1) for i, v in enumerate(sorted(data["a"]))}
    assert none[0] == 0 and tuple(none[1]) == (0, 0, None)


def test_auroc(spark):
    rng = np.random.default_rng(1)
    rows = [(bool(rng.random() < 0.4), float(rng.integers(0, 12))) for _ in range(200)] + [(None, 1.0), (True, None)]
    got = G.auroc(spark.createDataFrame(rows, "won boolean, score double"), "won", "score").collect()[0]
    pos, neg = ([s for w, s in rows if w is k and s is not None] for k in (True, False))
    wanted = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert (got["positive"], got["negative"]) == (len(pos), len(neg)) and got["auroc"] == pytest.approx(wanted)


def test_paired_difference(spark):
    rng = np.random.default_rng(3)
    rows = [(int(b), float(x), float(x * 0.5 + rng.normal(0, 0.2))) for b in range(12) for x in rng.normal(0.1, 1, 20)]
    df = spark.createDataFrame(rows, "block int, arm double, base double")
    got = paired_difference(df, "block", "arm", "base", 400, 7).collect()[0]
    x = np.array(rows)
    ratio = lambda v: v.mean() / v.std(ddof=1) * math.sqrt(252)
    drawn = [np.concatenate([x[x[:, 0] == k] for k in rng.integers(0, 12, 12)]) for _ in range(2000)]
    d = [ratio(y[:, 1]) - ratio(y[:, 2]) for y in drawn]
    assert got["draws"] == 400 and got["mean"] == pytest.approx(np.mean(d), abs=0.25 * np.std(d))
    assert got["lo"] == pytest.approx(np.quantile(d, 0.025), abs=0.5 * np.std(d)) and got["hi"] == pytest.approx(np.quantile(d, 0.975), abs=0.5 * np.std(d))
    same = paired_difference(df, "block", "arm", "arm", 50, 7).collect()[0]
    assert tuple(same) == (50, 0.0, 0.0, 0.0)  # both arms get the same draws
    assert paired_difference(df.limit(0), "block", "arm", "base", 50, 7).collect()[0]["draws"] == 0


def test_projection(spark):
    rng = np.random.default_rng(8)
    names, load = [f"t{k}" for k in range(7)], rng.normal(size=(7, 2))
    logs = np.cumsum(rng.normal(0, 0.02, (60, 2)) @ load.T + rng.normal(0, 0.002, (60, 7)), axis=0)
    rows = [(n, d, float(np.exp(logs[d, k]))) for k, n in enumerate(names) for d in range(60)] + [("gappy", d, 1.0 + d) for d in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "ticker string, ts int, value double")
    got = {(r["ticker"], r["ts"]): r["residual_log_price"] for r in projected_residuals(df.where("ts < 40"), df.where("ts >= 40"), 2, 5, 5).collect()}
    form, trade = np.diff(logs[:40], axis=0), np.diff(logs[40:], axis=0)
    w = np.linalg.svd(form - form.mean(0), full_matrices=False)[2][:2].T
    wanted = logs[40] + np.vstack([np.zeros(7), np.cumsum(trade - trade @ w @ w.T, axis=0)])
    assert got.keys() == {(n, d) for n in names for d in range(40, 60)}
    assert all(got[n, d] == pytest.approx(wanted[d - 40, k]) for k, n in enumerate(names) for d in range(40, 60))


@pytest.fixture
def received(monkeypatch, spark):
    """How many values the driver has received."""
    kind, seen = type(spark.range(1)), []
    for name, size in (("collect", lambda x: sum(map(len, x))), ("toPandas", lambda x: x.size), ("toArrow", lambda t: sum(len(c.combine_chunks().flatten()) if "list" in str(c.type) else len(c) for c in t.columns))):
        plain = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, plain=plain, size=size: (got := plain(self), seen.append(size(got)))[0])
    return seen


@pytest.mark.parametrize("days,components", [(12, 3), (5, 5)])
def test_projection_of_more_tickers_than_days(spark, received, days, components):
    """The driver solves days by days; with five days the four returns leave three directions once they are centred."""
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(0, 0.1, (days + 6, 150)), axis=0)
    df = spark.createDataFrame([(k, d, float(np.exp(v))) for (d, k), v in np.ndenumerate(x)], "ticker bigint, ts int, value double")
    out = projected_residuals(df.where(F.col("ts") < days), df.where(F.col("ts") >= days), components, 5, 5)
    assert sum(received) < 2 * days * days + 10
    form, trade = np.diff(x[:days], axis=0), np.diff(x[days:], axis=0)
    w = np.linalg.svd(form - form.mean(0), full_matrices=False)[2][: min(components, days - 2)].T
    wanted = x[days] + np.vstack([np.zeros(150), np.cumsum(trade - trade @ w @ w.T, axis=0)])
    got = out.toPandas().pivot(index="ts", columns="ticker", values="residual_log_price")
    np.testing.assert_allclose(got.to_numpy(), wanted, atol=1e-8)
