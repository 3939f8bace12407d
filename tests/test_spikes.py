"""Spikes, stuck values and impossible values against brute force, over many partition boundaries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.spikes import away_and_back, halo, implausible, local_features, looked_at, normal_levels, robust_low_rank, suspect_cells, typical_steps

LIMITS = {"t|x": 20.0, "b|x": 20.0}
RUNS = {"t|x": ("readings", 10), "b|x": ("sessions", 5)}


def brute(v, day, sessions):
    x = np.log(v)
    step = np.sort(np.abs(np.diff(x)))
    typical = step[(len(step) - 1) // 2] if len(step) else np.inf
    out = np.zeros(len(v), bool)
    for i in range(1, len(v)):
        for m in (1, 2, 3):
            if i + m < len(v):
                a, b, part = x[i - 1], x[i + m], x[i : i + m]
                if min(part) - max(a, b) > 20 * typical or min(a, b) - max(part) > 20 * typical:
                    out[i : i + m] = True
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i] and (sessions or day[j + 1] == day[i]):
            j += 1
        if (len(set(day[i : j + 1])) >= 5) if sessions else (j - i + 1 >= 10):
            out[i : j + 1] = True
        i = j + 1
    return out


def make(seed, n, kind):
    rng = np.random.default_rng(seed)
    v = 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, n)))
    for at, width, by in ((n // 5, 1, 1.3), (n // 3, 3, 0.6), (n // 2, 4, 1.5), (n - 2, 1, 2.0)):
        v[at : at + width] *= by
    v[2 * n // 3 :] *= 3  # a lasting change of level
    v[n // 10 : n // 10 + 12] = v[n // 10]
    day = np.arange(n) // (25 if kind == "t" else 2)
    return v, day


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (1, 7), (7, 10_000), (7, 20), (60, 1)])
def test_against_brute_force(spark, partitions, batch):
    rows, wanted, at = [], set(), 0
    for kind in "tb":
        for s in range(3):
            v, day = make(s, 240, kind)
            ids = at + np.arange(len(v))
            at += len(v)
            rows += [(f"{kind}|x|s{s}", int(k), int(i), float(a), int(d)) for k, (i, a, d) in enumerate(zip(ids, v, day))]
            wanted |= {int(i) for i in ids[brute(v, day, kind == "b")]}
    df = spark.createDataFrame(rows, "series string, ord bigint, row_id bigint, value double, day int")
    df = df.selectExpr("*", "ln(value) as level", "day as cell_row", "cast(ord % 25 as int) as cell_col", "series like 't%' as by_day")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [r["row_id"] for r in implausible(df, LIMITS, RUNS).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(wanted)


def test_no_rows_and_short_series(spark):
    schema = "series string, ord bigint, row_id bigint, value double, day int, level double, cell_row int, cell_col int, by_day boolean"
    assert implausible(spark.createDataFrame([], schema), LIMITS, RUNS).count() == 0
    one = spark.createDataFrame([("t|x|a", 1, 1, 1.0, 1, 0.0, 1, 1, True), ("t|x|b", 1, 2, 1.0, 1, 0.0, 1, 1, True), ("t|x|b", 2, 3, 9.0, 1, 2.2, 1, 1, True)], schema)
    assert implausible(one, LIMITS, RUNS).count() == 0


def test_a_change_of_level_is_no_spike():
    x = np.array([0, 0, 0, 5, 5, 5, 5, 0, 9, 0.0])
    assert away_and_back(x, np.zeros(10)).tolist() == [0, 0, 0, 0, 0, 0, 0, 5, 9, 0]


def test_low_rank_part_leaves_spikes_out():
    rng = np.random.default_rng(1)
    base = np.outer(rng.uniform(1, 2, 40), rng.uniform(1, 2, 24))
    m = base.copy()
    m[3, 5] += 10
    m[17, 20] += 10
    low = robust_low_rank(m)
    assert abs(low[3, 5] - base[3, 5]) < 0.5 and np.abs(low - base).mean() < 0.1
    assert not robust_low_rank(np.zeros((3, 4))).any()


def profiles(level, typical=0.001, limit=20.0):
    """Cells of one reading each of a days x times matrix of levels."""
    high, low = halo(level.ravel(), np.zeros(level.size))
    row, col = np.divmod(np.arange(level.size), level.shape[1])
    return pd.DataFrame({"series": "s", "cell_row": row, "cell_col": col, "high": high, "low": low, "typical": typical, "limit": limit})


def drifting(rng, days, times):
    """Days of different levels with a common shape over the day: low rank, and no plain average is near all of it."""
    return np.cumsum(rng.normal(0, 0.008, days))[:, None] + np.sin(np.arange(times) / 4) * rng.uniform(0.001, 0.004, days)[:, None] + rng.normal(0, 0.0003, (days, times))


def test_low_rank_part_decides_the_cells():
    """Several spikes in one day and one time of day: they stay suspects, and without the low-rank part (a plain median
    as the normal level) most of the other cells would be suspects as well."""
    level = drifting(np.random.default_rng(3), 30, 24)
    spikes = [(7, 2), (7, 9), (7, 15), (7, 21), (3, 9), (12, 9), (19, 9), (27, 9)]
    for k, (i, j) in enumerate(spikes):
        level[i, j] += 0.1 * (-1) ** k
    cells = profiles(level)
    found = suspect_cells(cells)
    assert set(spikes) <= set(zip(found["cell_row"], found["cell_col"]))
    by_median = suspect_cells(cells, lambda high, low: np.full(high.shape, np.nanmedian(high)))
    assert set(spikes) <= set(zip(by_median["cell_row"], by_median["cell_col"]))
    assert len(found) < 0.25 * len(cells) and len(by_median) > 0.5 * len(cells)
    score = found.set_index(["cell_row", "cell_col"])["score"]
    assert all(score[s] > 40 for s in spikes)


def test_no_cell_with_a_case_is_let_off():
    """Whatever the normal levels are, a cell with a reading beyond the rule's limit is a suspect."""
    rng = np.random.default_rng(5)
    for k in range(40):
        level = np.cumsum(rng.normal(0, 0.001, 12 * 8)).reshape(12, 8)
        for i, j in rng.integers(0, (12, 8), (rng.integers(1, 25), 2)):
            level[i, j] += rng.choice([-1, 1]) * rng.uniform(0.01, 0.2)
        x = level.ravel()
        case = away_and_back(x, np.zeros(x.size)) > 20 * 0.001
        for normal in (normal_levels, lambda h, l: h + rng.normal(0, 0.1, h.shape), lambda h, l: np.zeros(h.shape)):
            got = suspect_cells(profiles(level), normal)
            assert {divmod(int(i), 8) for i in np.flatnonzero(case)} <= set(zip(got["cell_row"], got["cell_col"]))


def test_profiles_of_odd_sources():
    assert len(suspect_cells(profiles(np.zeros((3, 4)), 0.0))) == 0
    assert len(suspect_cells(profiles(np.array([[0.0, 0, 0, 0, 1e-9, 0, 0, 0]]), 0.0)))
    infinite = profiles(np.array([[0.0, 0, np.inf, 0, 0, 0, 0, 0.0]]))
    assert (0, 2) in set(zip(suspect_cells(infinite)["cell_row"], suspect_cells(infinite)["cell_col"]))


def test_typical_step_is_the_exact_median(spark):
    rng = np.random.default_rng(9)
    steps = {"a": rng.lognormal(-7, 1, 1001), "b": rng.lognormal(-3, 2, 500), "c": np.zeros(4), "d": np.array([0.25]), "e": np.repeat([1e-4, 3e-4], 50)}
    rows = [(k, int(b)) for k, v in steps.items() for b in v.view(np.int64)]
    df = spark.createDataFrame(rows, "series string, bits bigint")
    counts = df.selectExpr("series", "shiftright(bits, 45) as bits", "1L as n")
    got = {r["series"]: r["typical"] for r in typical_steps(df, counts).collect()}
    assert got == {k: float(np.median(v)) for k, v in steps.items()}
    assert typical_steps(df.limit(0), counts.limit(0)).count() == 0


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (5, 30), (40, 3)])
def test_the_exact_rule_looks_at_suspect_cells_alone(spark, partitions, batch):
    """What isn't suspect isn't computed; what is has its true distance, over batches, partitions and cells."""
    level = drifting(np.random.default_rng(3), 30, 24)
    level[7, [2, 9, 15]] += 0.1
    level[12:14, 9] -= 0.1
    level = np.append(level.ravel(), level.ravel()[::-1])
    series, k = np.divmod(np.arange(1440), 720)
    rows = [(f"t|x|{s}", int(i), int(r), float(np.exp(x)), float(x), int(i // 24), int(i // 24), int(i % 24 // 2), True) for r, (s, i, x) in enumerate(zip(series, k, level))]
    df = spark.createDataFrame(rows, "series string, ord bigint, row_id bigint, value double, level double, day int, cell_row int, cell_col int, by_day boolean")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        cells = local_features(df)[0].where("kind = 'cell'")
        held = cells.select("series", "cell_row", "cell_col", "high", "low").toPandas().groupby(["series", "cell_row", "cell_col"], as_index=False).agg({"high": "max", "low": "min"})
        found = pd.concat(suspect_cells(x.assign(typical=0.001, limit=20.0)) for _, x in held.groupby("series"))
        got = looked_at(cells, spark.createDataFrame(found, "series string, cell_row int, cell_col int, score double")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = set(zip(found["series"], found["cell_row"], found["cell_col"]))
    inside = [r[2] for r in rows if (r[0], r[6], r[7]) in wanted]
    dev = got.groupby("row_id")["dev"].max()
    assert sorted(dev.index) == inside and 0 < len(inside) < 0.3 * len(rows)
    np.testing.assert_array_equal(dev.to_numpy(), away_and_back(level, series)[inside])
