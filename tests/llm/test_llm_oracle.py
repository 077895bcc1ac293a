import os

import duckdb
import pytest

from skeinlab.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted(str([x[names.index(c)] for c in cols]) for x in r.fetchall()) == sorted(str([r[c] for c in cols]) for r in df.collect())


def test_every_query_runs(spark):
    for name, f in Q.queries().items():
        assert f(spark, SF).columns, name
