"""Every registered core query against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from lodestone.plans import service  # noqa: F401
from lodestone.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, oracle, name):
    function, sql = CATALOG[name]
    df = function(spark, DATA)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)
    if sql is None:
        assert rows
        return
    result = oracle.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
