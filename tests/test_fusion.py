"""Fusion of whole rankings: every entity of either list has its row."""

import os

import duckdb
import pytest

from knowgrid.operators import search
from knowgrid.queries import analytics

DIR = "/root/testdata/sf0.01"


def test_rank_all(spark):
    df = spark.createDataFrame([(i, (i * 37) % 50) for i in range(500)], "entity long, v long").repartition(7)
    got = {r.entity: r["rank"] for r in search.rank_all(df, "v", "entity").collect()}
    want = sorted(range(500), key=lambda i: (-((i * 37) % 50), i))
    assert got == {e: k + 1 for k, e in enumerate(want)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize(("name", "damp"), [("rrf_fusion", 60), ("fuse_ranks", 1)])
def test_whole_lists_are_fused(spark, name, damp):
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = c.execute(
        f"""WITH l AS (SELECT 'balance' AS list, c_custkey AS entity, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer
        UNION ALL SELECT 'orders', o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))
        SELECT entity, round(sum(1.0 / ({damp} + rank)), 9) AS score FROM l GROUP BY entity"""
    ).fetchall()
    got = {r.entity: r.score for r in analytics.QUERIES[name](spark, DIR).collect()}
    assert got == pytest.approx(dict(want), abs=2e-9)
