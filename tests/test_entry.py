"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(frame, columns):
    import pandas as pd

    def text(x):
        if isinstance(x, float):
            return "null" if pd.isna(x) else format(x, ".9g")
        return "null" if x is None or x is pd.NaT or x is pd.NA else str(x)

    return sorted("|".join(map(text, r)) for r in frame[columns].itertuples(index=False, name=None))


CORE = sorted(k for k, f in entry.queries().items() if ".llm" not in f.__module__)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, db, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
