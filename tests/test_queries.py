from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from varnaflow.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def _rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return round(x, 6) if isinstance(x, float) else x

    columns = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in row) for row in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
