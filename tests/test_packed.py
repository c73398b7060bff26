import pytest

from knowgrid.operators.packed import unpack, unpack_values

CASES = [
    ("a; b ;c", ["a", "b", "c"]),
    ("a,,b,", ["a", "b"]),
    ("ci/cd / a/b testing / i/o", ["ci/cd", "a/b testing", "i/o"]),
    ("x|y\tz\nw", ["x", "y", "z", "w"]),
    ('"storage; cold tier", b', ["storage; cold tier", "b"]),
    ('"so-called ""fast path""";b', ['so-called "fast path"', "b"]),
    ("'payments, ledger, tax',b", ["payments, ledger, tax", "b"]),
    ('["a", "the \\"blue\\" rollout","c; d"]', ["a", 'the "blue" rollout', "c; d"]),
    ("[]", []),
    ('a;"b;c', ["a", '"b', "c"]),
    ('"a" b;c', ['"a" b', "c"]),
    ("it's;that's", ["it's", "that's"]),
    ("r&d;c++;node.js", ["r&d", "c++", "node.js"]),
    ("a;a", ["a", "a"]),
    (";", []),
    (" ", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_values(text, want):
    got = unpack(text)
    assert [v for _, v, _ in got] == want
    assert [p for p, _, _ in got] == list(range(1, len(want) + 1))


def test_flags():
    assert [f for _, _, f in unpack('a;"b;c')] == ["", "quote", ""]
    assert {f for _, _, f in unpack("[a, b")} == {"bracket"}


def test_round_trip_and_table(spark):
    words = ["a;b", 'say "x"', "plain", "c, d", "e|f", "tab\tg"]
    packed = ";".join('"' + w.replace('"', '""') + '"' for w in words)
    df = spark.createDataFrame([(1, packed, 9), (1, packed, 9), (2, None, 9), (3, "y" * 300_000, 9)], "id long, t string, pos int")
    got = unpack_values(df, "id", "t", "topic").collect()
    assert [r.topic for r in got if r.id == 1] == words * 2
    assert {r.id for r in got} == {1, 3}
    assert unpack_values(df.limit(0), "id", "t", "topic").count() == 0
