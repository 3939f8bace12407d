"""Every query over tables without rows."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from tidemark.plans import problems, relations, research, series, validation

QUERIES = {n: f for m in (series, relations, research, validation, problems) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    to = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{sf}/*.parquet"):
        pq.write_table(pq.read_table(path).slice(0, 0), str(to / os.path.basename(path)))
    return str(to)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    QUERIES[name](spark, empty).collect()
