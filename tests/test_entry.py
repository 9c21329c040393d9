import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomline import plans as catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    cur = tables.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
