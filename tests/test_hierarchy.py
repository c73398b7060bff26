import random

from knowgrid.operators import hierarchy as H


def brute(parent):
    out = {}
    for n in parent:
        path, seen = [n], {n}
        while (p := parent[path[-1]]) in parent:
            if p in seen:
                path = None
                break
            path.append(p)
            seen.add(p)
        out[n] = (path[-1], len(path) - 1, ">".join(reversed(path))) if path else ("cycle", -1, "")
    return out


def run(spark, parent):
    df = spark.createDataFrame([(n, p, "x") for n, p in parent.items()], "node string, parent string, chain string")
    return H.hierarchy(df).cache()


def test_random_forest_with_circles_and_deep_chain(spark):
    rng = random.Random(3)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else rng.choice([None, "", "absent"])) for i in range(300)}
    parent |= {f"d{i}": f"d{i - 1}" if i else None for i in range(130)}
    parent |= {f"hot{i}": "d0" for i in range(300)}
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "c4": "c3", "c5": "c4", "self": "self", "below": "self"}
    tree = run(spark, parent)
    rows = {r.node: r for r in tree.collect()}
    assert {n: (r.root_node, r.lvl, r.node_path) for n, r in rows.items()} == brute(parent)
    # Nested sets: exactly the nodes below lie in a range, and numbers are distinct.
    inside = [r for r in rows.values() if not r.in_circle]
    assert sorted(r.lft for r in inside) == list(range(1, len(inside) + 1))
    for r in rng.sample(inside, 60):
        below = {x.node for x in inside if r.lft <= x.lft < r.lft + r["size"]}
        assert below == {x.node for x in inside if r.node in x.node_path.split(">")}
    pairs = {(r.ancestor, r.node) for r in H.descendants(tree).collect()}
    assert pairs == {(a, r.node) for r in inside for a in r.node_path.split(">")[:-1]}


def test_empty_and_null_nodes(spark):
    assert run(spark, {"a": None}).count() == 1
    df = spark.createDataFrame([(None, "a")], "node string, parent string")
    assert H.hierarchy(df).count() == 0


def test_hot_nodes_and_block_borders(spark):
    """Spread look-ups and small blocks give what whole ones give, ancestors reaching over many blocks included."""
    rng = random.Random(8)
    parent = {"r": None} | {f"k{i}": "r" for i in range(120)} | {f"m{i}": f"k{rng.randrange(3)}" for i in range(200)} | {f"z{i}": f"z{i - 1}" if i else "m7" for i in range(40)} | {"o": "p", "p": "o"}
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node: (r.root_node, r.lvl, r.node_path) for r in H.hierarchy(df, hot_nodes=5, sweep_nodes=7).collect()}
    assert got == brute(parent)
    slashes = {r.node: r.node_path for r in H.hierarchy(df, sep="/").collect()}
    assert slashes["k1"] == "r/k1"
    pairs = {(r.ancestor, r.node) for r in H.descendants(H.hierarchy(df, sep="/"), sweep_nodes=9).collect()}
    assert pairs == {(a, n) for n, (_, _, path) in got.items() for a in path.split(">")[:-1]}
