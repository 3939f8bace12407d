"""Nearest-time matching against brute force, with ties, hot keys and any tick length."""

import random

import pytest

from tidemark.llm.nearest import nearest_in_time


def brute(left, right, tolerance):
    out = []
    for e, at, i in left:
        near = [(abs(t - at), j) for k, t, j in right if k == e and e is not None and at is not None and t is not None and abs(t - at) <= tolerance]
        if near:
            out.append((i, min(near)[1]))
    return sorted(out)


@pytest.mark.parametrize("tick,coarse", [(1, 6), (3, 30), (50, 100), (1000, 1000), (7, 7_000_000)])
def test_against_brute_force(spark, tick, coarse):
    rng = random.Random(tick)
    right = [(rng.choice("aaaab"), rng.randrange(2000), j) for j in range(400)] + [("a", 500, j) for j in range(400, 420)] + [(None, 5, 900), ("a", None, 901)]
    left = [(rng.choice("abc"), rng.randrange(-50, 2050), i) for i in range(300)] + [("a", 500, 7), ("a", 500, 7), (None, 5, 901), ("a", None, 902)]
    r = spark.createDataFrame(right, "ticker string, at bigint, rid bigint").selectExpr("*", "1 as tick", "2 as e")
    l = spark.createDataFrame(left, "ticker string, at bigint, lid bigint").selectExpr("*", "'x' as rid")
    got = nearest_in_time(l, r, "ticker", "at", "at", "lid", "rid", 10, tick, coarse)
    assert sorted(map(tuple, got.collect())) == brute(left, right, 10)


def test_empty_tables_and_bad_parameters(spark):
    df = spark.createDataFrame([], "ticker string, at bigint, id bigint")
    assert nearest_in_time(df, df.withColumnRenamed("id", "rid"), "ticker", "at", "at", "id", "rid", 5).count() == 0
    with pytest.raises(ValueError):
        nearest_in_time(df, df, "ticker", "at", "at", "id", "id", -1)


def test_no_tolerance_means_equal_times(spark):
    l = spark.createDataFrame([("a", 5, 1), ("a", 6, 2)], "ticker string, at bigint, id bigint")
    r = spark.createDataFrame([("a", 5, 9), ("a", 5, 8), ("a", 7, 3)], "ticker string, at bigint, rid bigint")
    assert [tuple(x) for x in nearest_in_time(l, r, "ticker", "at", "at", "id", "rid", 0).collect()] == [(1, 8)]
