import glob
import os

import duckdb
import pytest

from knowgrid.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", Q.ORACLE)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(DIR + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = Q.QUERIES[name](spark, DIR).toPandas(), c.execute(Q.ORACLE[name]).df()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE])
def test_runs_with_unique_rows(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    assert df.count() == df.distinct().count() > 0
