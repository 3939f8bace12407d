"""The queries of this subpackage against their SQL, and over tables without rows."""

import glob
import os
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(map(tuple, rel.fetchall()))


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    to = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{sf}/*.parquet"):
        pq.write_table(pq.read_table(path).slice(0, 0), str(to / os.path.basename(path)))
    return str(to)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
