"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from knowgrid.queries import analytics, knowledge, training_core

DIR = "/root/testdata/sf0.001"
PAIRS = [(n, m) for m in (analytics, knowledge, training_core) for n in m.ORACLE]


def rows(df):
    cols = sorted(df.columns)

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return cols, sorted((tuple(cell(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize(("name", "module"), PAIRS, ids=[n for n, _ in PAIRS])
def test_against_sql(spark, name, module):
    c = duckdb.connect()
    for f in glob.glob(DIR + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(module.QUERIES[name](spark, DIR).toPandas()) == rows(c.execute(module.ORACLE[name]).df())
