import pytest

from knowgrid.operators import badrows as B

GOOD = '"Doe, Ann",ann@a.example,"Eng ""X""",Team,Org,,a;b'
CASES = [
    (GOOD, None),
    (GOOD + "\r", None),
    ("Ann,ann@a.example,x,y,z,boss@a.example,t", None),
    ("Ann,ann@a.example,x,y,z,boss@a.example", "columns"),
    ("", "columns"),
    (" ", "columns"),
    (None, "columns"),
    ('"Ann,ann@a.example,x,y,z,,t', "quoting"),
    ('Ann "A" B,ann@a.example,x,y,z,,t', "quoting"),
    ('"Ann" x,ann@a.example,x,y,z,,t', "quoting"),
    ('""Ann",ann@a.example,x,y,z,,t', "quoting"),
    ('"Ann \\"A",ann@a.example,x,y,z,,t', "quoting"),
    (",,x,y,z,,t", "value"),
    (" , ,x,y,z,,t", "value"),
    ("Ann,ann.a.example,x,y,z,,t", "value"),
    ("Ann,a@b.example@c.example,x,y,z,,t", "value"),
    ("Ann,ann@a.example,x,y,z,EMP12,t", "value"),
    ("Ann,ann@a.example,x,y,z,Bob <b@a.example>,t", "value"),
    ("123,ann@a.example,x,y,z,,t", "value"),
    ("An\x01n,ann@a.example,x,y,z,,t", "value"),
    ("An�n,ann@a.example,x,y,z,,t", "value"),
    ('Ann,ann@a.example,"x\ny",y,z,,t', None),
    ("Åse,,x,y,z,,t", None),
    (",ann@a.example,x,y,z,,t", None),
]


@pytest.mark.parametrize(("line", "reason"), CASES)
def test_single_records(line, reason):
    assert B.diagnose(line)[0] == reason


def test_blocks_agree_with_single_records(spark):
    rows = [(i, *CASES[i % len(CASES)]) for i in range(3000)]
    df = spark.createDataFrame([(i, line, "mine") for i, line, _ in rows], "raw_id long, raw_line string, reason string")
    got = {r.raw_id: r.reason for r in B.separate_bad_rows(df).collect()}
    assert got == {i: reason for i, _, reason in rows}


def test_fields_and_empty_table(spark):
    df = spark.createDataFrame([(1, GOOD)], "raw_id long, raw_line string")
    r = B.separate_bad_rows(df).first()
    assert (r["name"], r["title"], r["manager"], r["topics"]) == ("Doe, Ann", 'Eng "X"', "", "a;b")
    assert B.separate_bad_rows(df.limit(0)).count() == 0


def test_repeated_and_long_rows(spark):
    long = "A" * 200_000 + ",a@a.example,x,y,z,,t"
    df = spark.createDataFrame([(1, long), (1, long), (2, '"' + long)], "raw_id long, raw_line string")
    assert sorted(((r.raw_id, r.reason) for r in B.separate_bad_rows(df).collect()), key=str) == [(1, None), (1, None), (2, "quoting")]
