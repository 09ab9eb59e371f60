"""The registered queries of the subpackage against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
NAMES = sorted(k for k, f in entry.queries().items() if ".llm" in f.__module__)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        db = duckdb.connect()
        for p in glob.glob(f"{FOLDER}/*.parquet"):
            db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        cursor = db.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
