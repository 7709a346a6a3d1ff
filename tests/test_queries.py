"""All registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from inquest.plans.tables import BASE
from tools.check_queries import norm

SF = "/root/testdata/sf0.001"
KEYS = sorted(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", [k for k in KEYS if not k.startswith(("op", "pipeline"))])
def test_query_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    assert got == want


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
