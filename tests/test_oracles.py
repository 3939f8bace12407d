"""Every query that SQL can express against DuckDB, over whole tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import problems, relations, research, series, validation

MODULES = (series, relations, research, validation, problems)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in m.SQL.items()}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    wanted = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in rel.fetchall())
    assert Counter(tuple(plain(v) for v in row) for row in df.select(*cols).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()


def test_entry_lists_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0
