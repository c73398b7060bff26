import random

import pytest

from knowgrid.llm import packing as K


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    h = {length: rng.randrange(1, 4000) for length in rng.sample(range(1, 201), 30)}
    plan, rest = K.plan_containers(h, 200)
    items = lambda p: sum(n * m for conf, n in p for m in conf.values())
    assert items(plan) >= 0.9 * sum(h.values())
    plan = plan + rest
    used = {}
    for conf, n in plan:
        assert sum(a * b for a, b in conf.items()) <= 200
        for a, b in conf.items():
            used[a] = used.get(a, 0) + b * n
    assert used == h
    # No packing can do with fewer: by volume, and by items too long to share a container (for any cut k).
    least = sum(a * b for a, b in h.items()) / 200
    for k in range(101):
        long, mid = sum(n for a, n in h.items() if a > 200 - k), sum(n for a, n in h.items() if 100 < a <= 200 - k)
        rest = sum(a * n for a, n in h.items() if k <= a <= 100) - (mid * 200 - sum(a * n for a, n in h.items() if 100 < a <= 200 - k))
        least = max(least, long + mid + max(0, rest) / 200)
    assert sum(n for _, n in plan) <= 1.06 * least + 5


def _count(h):
    plan, rest = K.plan_containers(h, 2048)
    return sum(n for _, n in plan + rest)


@pytest.mark.parametrize("n", [100, 8000, 8_000_000])
def test_configurations_beat_best_fit_where_lengths_are_few(n):
    h = {1025: n, 1000: n, 700: n, 690: n, 658: n, 400: n}
    assert _count(h) < sum(k for _, k in K.best_fit(h, 2048))


def test_many_lengths_of_few_items_meet_the_bound():
    rng = random.Random(3)
    h = {}
    for _ in range(1500):
        length = min(2048, int(rng.lognormvariate(5, 0.9)) + 1)
        h[length] = h.get(length, 0) + 1
    plan, rest = K.plan_containers(h, 2048)
    bound = -(-sum(a * b for a, b in h.items()) // 2048)
    assert sum(n for _, n in plan + rest) <= 1.01 * bound + 1
    assert sum(n * m for conf, n in plan for m in conf.values()) >= 0.9 * 1500


def test_no_items_need_no_containers():
    assert K.plan_containers({}, 2048) == ([], [])
    assert K.plan_containers({2048: 3}, 2048) == ([({2048: 1}, 3)], [])


def test_program_covers_every_length():
    import numpy as np

    rng = random.Random(7)
    lengths = np.array(sorted(rng.sample(range(1, 1025), 300)))
    counts = np.array([float(rng.randrange(1, 40)) for _ in lengths])
    got = K.solve_program(lengths, counts, 1024)
    cover = np.zeros(len(lengths))
    for conf, x in got:
        assert sum(int(lengths[k]) * n for k, n in conf.items()) <= 1024
        for k, n in conf.items():
            cover[k] += x * n
    assert (cover >= counts * (1 - 1e-9)).all()
    assert sum(x for _, x in got) <= 1.5 * float(lengths @ counts) / 1024


def test_pricing_is_the_best_bounded_knapsack():
    import itertools

    import numpy as np

    rng = random.Random(1)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 15), 4)))
        counts = np.array([float(rng.randrange(1, 5)) for _ in lengths])
        value = np.array([rng.random() for _ in lengths])
        pricing = K.Pricing(lengths, counts, 30)
        best = pricing.solve(value)
        conf = pricing.read(30)
        assert sum(int(lengths[k]) * n for k, n in conf.items()) <= 30 and all(n <= counts[k] for k, n in conf.items())
        ways = itertools.product(*(range(int(c) + 1) for c in counts))
        want = max(value @ w for w in map(np.array, ways) if lengths @ w <= 30)
        assert abs(best[30] - want) < 1e-9 and abs(sum(value[k] * n for k, n in conf.items()) - want) < 1e-9


def test_table(spark):
    rows = [(i, random.Random(i).randrange(0, 300)) for i in range(500)] + [(1000, 2500), (1001, None), (1002, 0)] + [(2000 + i, 64) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = K.pack(df, capacity=256).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.token_from, r.n_tokens))
    assert max(fill.values()) <= 256 and sorted(fill) == list(range(len(fill)))
    want = {d: n for d, n in rows if n}
    assert {d: sum(x[2] for x in p) for d, p in parts.items()} == want
    assert all(len(p) == max(1, -(-want[d] // 256)) for d, p in parts.items())
    assert len(fill) <= 1.02 * sum(want.values()) / 256 + 2
    assert K.pack(df.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in K.count_tokens(df, "doc_id", "text").collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 1
