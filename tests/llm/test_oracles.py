import os

import duckdb
import pytest

from loomline.llm import oracles, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want
