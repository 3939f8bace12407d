"""The regular grid and the merged intervals, against brute force."""

import random

import numpy as np
import pytest

from tidemark.operators.intervals import carried, merged_periods
from tidemark.operators.regular_grid import regular_series, ssa_fill, ssa_round


def test_ssa_restores_a_periodic_series():
    t = np.arange(120)
    truth = 10 + np.sin(t / 5) + 0.3 * np.cos(t / 3)
    holed = truth.copy()
    gaps = [17, 18, 40, 77, 78, 79]
    holed[gaps] = np.nan
    wide = np.full((2, 150), np.nan)
    wide[0, :120], wide[1, :30] = holed, truth[:30]
    wide[1, 11] = np.nan
    got, settled = ssa_fill(wide, np.array([120, 30]), 24, 4, 1e-6, 500)
    assert settled.all()
    assert np.abs(got[0, gaps] - truth[gaps]).max() < 0.02
    assert np.isnan(got[0, 120:]).all() and np.allclose(got[0, :120][~np.isnan(holed)], holed[~np.isnan(holed)])
    alone, _ = ssa_fill(holed[None, :], np.array([120]), 24, 4, 1e-6, 500)
    assert np.allclose(alone[0], got[0, :120])  # a result doesn't depend on the batch


def plain_iteration(holed, size, rank, rounds):
    """The textbook loop, one series, written on its own; -> (filled, last movement)."""
    gap = np.isnan(holed)
    t = np.arange(len(holed))
    mean = holed[~gap].mean()
    x = holed - mean
    x[gap] = np.interp(t[gap], t[~gap], x[~gap])
    for _ in range(rounds):
        h = np.array([x[i : i + len(x) - size + 1] for i in range(size)])
        u, s, v = np.linalg.svd(h, full_matrices=False)
        low = (u[:, :rank] * s[:rank]) @ v[:rank]
        smooth = np.array([np.mean([low[i, k - i] for i in range(size) if 0 <= k - i < low.shape[1]]) for k in range(len(x))])
        moved = np.abs(smooth - x)[gap].max()
        x[gap] = smooth[gap]
        if moved < 1e-12:
            break
    return x + mean, moved


def test_fill_is_the_limit_of_the_plain_iteration():
    rng = np.random.default_rng(2)
    same = settled = 0
    for k in range(24):
        n = int(rng.integers(20, 70))
        x = 50 + np.sin(np.arange(n) / rng.uniform(2, 6)) + np.cumsum(rng.normal(0, 0.1, n))
        gap = rng.random(n) < rng.uniform(0.05, 0.3)
        gap[[0, -1]] = False
        gap[n // 2 : n // 2 + 3] = True
        x[gap] = np.nan
        got, done = ssa_fill(x[None, :], np.array([n]), 8, 3, 1e-9, 200)
        if not done[0]:
            continue
        settled += 1
        spread = x[~gap].std()
        centre = x[~gap].mean()
        again, _ = ssa_round(got - centre, np.array([n]), 8, 3)
        assert np.abs(again[0] + centre - got[0])[gap].max() < 1e-5 * spread  # the averages reproduce the gaps
        wanted, moved = plain_iteration(x, 8, 3, 3000)
        if moved < 1e-9:
            same += bool(np.abs(wanted - got[0]).max() < 1e-4 * spread)
        else:
            same += 1
    assert settled >= 22 and same >= settled - 2  # where there is more than one limit, the way decides which


def test_what_does_not_settle_is_told():
    x = np.array([[1.0, np.nan, 3, 5, np.nan, np.nan, 2, 8, 1, np.nan, 4, 4]])
    assert not ssa_fill(x, np.array([12]), 4, 2, 0.0, 3)[1][0]


def test_grid(spark):
    rows = [("A", 0, 10.0, 1.0), ("A", 60, 20.0, 3.0), ("A", 1200, 11.0, 1.0), ("A", 1200, 11.0, 1.0), ("B", 0, 5.0, 1.0), ("A", 600, -1.0, 1.0), ("A", 600, 9.0, 0.0), ("A", None, 9.0, 1.0), (None, 600, 9.0, 1.0), ("A", 700, None, 1.0), ("A", 700, float("nan"), 1.0), ("A", 90_000, 3.0, 1.0)]
    df = spark.createDataFrame([(t, None if s is None else (1_700_000_100 + s) * 1_000_000, p, z, "x") for t, s, p, z in rows], "ticker string, us bigint, price double, size double, filled string")
    got = {(r["series"], r["slot_start"] - 1_700_000_100): r for r in regular_series(df, "ticker", "us", "price", "size").collect()}
    assert sorted(got) == [("A", 0), ("A", 300), ("A", 600), ("A", 900), ("A", 1200), ("A", 90_000), ("B", 0)]
    assert [got["A", s]["filled"] for s in (0, 300, 600, 900, 1200)] == [False, True, True, True, False]
    assert got["A", 0]["price"] == 17.5 and got["A", 1200]["n"] == 2 and got["A", 300]["n"] == 0
    assert 10 < got["A", 600]["price"] < 18
    assert regular_series(df.limit(0), "ticker", "us", "price", "size").count() == 0


def brute(rows):
    out, now = [], None
    for e, s, t in sorted((e, s, t) for e, s, t in rows if e is not None and s is not None and t is not None and t > s):
        if now and now[0] == e and s <= now[2]:
            now[2] = max(now[2], t)
            continue
        if now:
            out.append(("period", *now))
            if now[0] == e:
                out.append(("gap", e, now[2], s))
        now = [e, s, t]
    return sorted(out + ([("period", *now)] if now else []))


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_merged_periods(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot", s := rng.randrange(100_000), s + rng.choice([5, 20, 400])) for _ in range(300)]
    rows += [(rng.choice("abc"), s := rng.randrange(300), s + rng.randrange(-3, 30)) for _ in range(200)]
    rows += rows[:40] + [("long", 0, 10**15), ("long", 5, 6), ("t", 0, 5), ("t", 5, 9), ("t", 10, 11), (None, 1, 2), ("n", None, 2), ("n", 1, None)]
    df = spark.createDataFrame(rows, "pair string, a bigint, b bigint").selectExpr("*", "'x' as kind", "1 as start_us")
    got = sorted(tuple(r) for r in merged_periods(df, "pair", "a", "b", partitions).collect())
    assert got == brute(rows)


def test_nothing_to_merge(spark):
    df = spark.createDataFrame([], "pair string, a bigint, b bigint")
    assert merged_periods(df, "pair", "a", "b", 3).count() == 0


def test_prefix_combination_carries_over_whole_partitions():
    parts = [(0, "a", "a", 0, 100), (2, "a", "a", 50, 60), (5, "a", "b", 7, 9)]
    assert carried(parts) == {2: ("a", 0, 100), 5: ("a", 0, 100)}
