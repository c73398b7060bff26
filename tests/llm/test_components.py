import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from knowgrid.llm import components as C


def brute(pairs):
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        par[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(par)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40))
def test_local_union_find(pairs):
    pairs = [(f"n{a:02}", f"n{b:02}") for a, b in pairs]
    u, v = (pa.chunked_array([pa.array(x)]) for x in zip(*pairs))
    names, roots = C.local_roots(u, v)
    assert dict(zip(names.to_pylist(), roots.to_pylist())) == brute(pairs)


@pytest.mark.parametrize("block", [40, 200, 10_000])
def test_rounds_over_many_blocks(spark, block):
    rng = random.Random(block)
    pairs = [(f"a{rng.randrange(400)}", f"a{rng.randrange(400)}") for _ in range(250)]
    pairs += [(f"p{i:03}", f"p{i + 1:03}") for i in range(200)] + [("hub", f"h{i}") for i in range(300)] + [("solo", "solo")]
    pairs += [(b, a) for a, b in pairs[:50]] + pairs[:50]
    edges = spark.createDataFrame([(a, b, 0) for a, b in pairs], "u string, v string, pid int")
    got = {r.v: r.root for r in C.connected_groups(edges, block).collect()}
    assert got == brute(pairs)


def test_match_rows(spark):
    rows = [(" A ", "b", 0.6), ("B", "c", 0.59), ("c", "C ", 1.0), ("", "d", 0.9), (None, "e", None), ("f", "g", None), ("g", "f", float("nan")), (None, None, 1.0), ("x" * 50_000, "a", 0.9)]
    df = spark.createDataFrame(rows, "alias string, canonical string, s double").withColumnRenamed("s", "a")
    got = {r.v[:3]: r.root[:3] for r in C.connected_groups(C.match_edges(df, "alias", "canonical", "a", 0.6)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f", "g": "g", "xxx": "a"}
    assert C.connected_groups(C.match_edges(df.limit(0), "alias", "canonical", "a", 0.6)).count() == 0


def test_a_giant_group_is_looked_up_in_parts(spark):
    pairs = [("hub", f"h{i}") for i in range(400)] + [(f"h{i}", f"t{i}") for i in range(0, 400, 3)] + [("q1", "q2")]
    edges = spark.createDataFrame(pairs, "u string, v string")
    got = {r.v: r.root for r in C.connected_groups(edges, 30, hot_vertices=20).collect()}
    assert got == brute(pairs)
