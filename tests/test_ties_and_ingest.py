"""Gates of ties, claims, path pairs, one-person groups, folding of records."""

from knowgrid.functions import text as T
from knowgrid.operators import ingest, knowledge, risk, search, ties
from pyspark.sql import functions as F

TIE = "a string, b string, weight double, witnesses long, sole string"


def edges(df):
    return {(r.a, r.b) for r in df.collect()}


def test_families_make_no_pair(spark):
    work = spark.createDataFrame([(u, t, "w") for u in range(6) for t in ("billing", "billing-api", "ledger")], "unit long, topic string, who string")
    assert edges(ties.cooccurrence(work)) == {("billing", "ledger"), ("billing-api", "ledger")}
    assert edges(ties.cooccurrence(ties.units(work))) == edges(ties.cooccurrence(work))


def test_gates_and_claims(spark):
    t = spark.createDataFrame([("a", "b", 0.5, 1, "p"), ("b", "a", 0.5, 1, "p"), ("a", "c", 0.4, 2, None), ("c", "d", 0.3, 2, None)], TIE)
    work = spark.createDataFrame([("a", f"k{i}") for i in range(4)] + [("b", "k0"), ("c", "k1"), ("c", None)], "topic string, container string")
    assert edges(ties.drop_spread(t, work)) == {("c", "d")}
    assert edges(ties.drop_spread(t, work.where("container < 'k2'"))) == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "d")}
    assert edges(ties.standing_only(t, spark.createDataFrame([("a",)], "topic string"))) == {("a", "b"), ("b", "a"), ("a", "c")}
    assert ties.standing_only(t, work.where("false")).count() == 4
    claims = spark.createDataFrame([("a", "b", 0.5, 2, None, "git"), ("a", "b", 0.7, 1, "x", "board"), ("a", "b", 0.7, 9, None, "chat"), ("a", "a", 1.0, 1, None, "git"), ("c", "d", 0.0, 1, None, "git")], TIE + ", source string")
    assert [tuple(r) for r in ties.strongest_claim(claims).collect()] == [("a", "b", 0.7, 1, "x", "board")]


def test_pairs_across_paths_only(spark):
    rows = [("c1", "x/a.go", t) for t in ("repo", "alpha", "beta")] + [("c1", "y/b.go", t) for t in ("repo", "gamma")] + [("c2", "x/a.go", "alpha"), ("c2", "x/a.go", "beta")]
    paths = spark.createDataFrame([(*r, "w", False) for r in rows], "unit string, path string, topic string, who string, deep boolean")
    common = knowledge.common_to_all(paths)
    assert {(r.unit, r.a, r.b) for r in ties.path_units(paths, common).collect()} == {("c1", "alpha", "gamma"), ("c1", "beta", "gamma")}


def test_what_one_person_holds_together(spark):
    spans = spark.createDataFrame([("p", "a", "b", 0.5), ("p", "b", "c", 0.2), ("p", "x", "y", 0.9), ("q", "a", "b", 0.4)], "person string, a string, b string, weight double")
    got = {(r.person, r.region, r.topics, r.ties, r.weakest) for r in ties.span_groups(spans).collect()}
    assert got == {("p", "a", 3, 2, 0.2), ("p", "x", 2, 1, 0.9), ("q", "a", 2, 1, 0.4)}


def test_folding(spark):
    rows = [("i", 1, "@login", "a@x", "Old", None), ("i", 2, "Real Name", "", None, None), ("i", 3, "git:login", None, "New", "boss"), ("j", 1, "@only", None, "", None), (None, 1, "N", "n@x", None, None)]
    r = spark.createDataFrame(rows, "id string, at int, name string, email string, title string, manager string")
    got = {x.id: tuple(x) for x in ingest.fold_identities(r, ["at"], ("email", "title", "manager")).collect()}
    assert got == {"i": ("i", "Real Name", "a@x", "New", "boss"), "j": ("j", "@only", None, None, None)}
    rec = lambda rows: spark.createDataFrame(rows, "id string, topics array<string>, members array<string>, w double")
    parts = [rec([("i", ["b", "a"], ["m"], 1.0), ("k", None, None, None)]), rec([("i", ["a"], ["n", "m"], 3.0)]), rec([("i", ["c"], None, 2.0), ("l", [], [], 0.5)])]
    fold = lambda a, b: ingest.fold_records(a, b, joined=("topics",), united=("members",), largest=("w",))
    got = {x.id: (x.topics, x.members, x.w) for x in fold(fold(parts[0], parts[1]), parts[2]).collect()}
    assert got == {"i": (["b", "a", "a", "c"], ["m", "n"], 3.0), "k": ([], [], None), "l": ([], [], 0.5)}
    assert fold(parts[0].limit(0), parts[0].limit(0)).count() == 0


def test_suggestions_and_top_topics(spark):
    p = spark.createDataFrame([(1, "Mira Lund", "m@x", "", ""), (2, "Olga Lundberg", "o@x", "", ""), (3, "Al", "al@x", "", "")], "id long, name string, email string, title string, team string")
    assert [tuple(r) for r in search.suggest(p, "Lund or mira?").collect()] == [(1, 60, "name"), (2, 40, "name")]
    assert search.suggest(p, "of").count() == 0
    pt = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "z", 1.0)], "person string, topic string, w double")
    got = [tuple(r) for r in risk.top_topics(pt, spark.createDataFrame([("y",)], "topic string"), 1).orderBy("person").collect()]
    assert got == [("a", "y", 2.0, 1), ("b", "x", 1.0, 1)]


def test_bytes_are_cut_between_characters_and_folding(spark):
    words = ["naïve café", "日本語テキスト", "a😀b😀c", "plain", "", "ééé", "Ångström Žluťoučký", "Привет й", "e\u0301x ﬁne"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, None)], "i long, s string")
    for limit in range(1, 9):
        got = {r.i: r.t for r in df.select("i", T.truncate_bytes(F.col("s"), limit).alias("t")).collect()}
        assert got == {99: None} | {i: w.encode()[:limit].decode(errors="ignore") for i, w in enumerate(words)}
    import unicodedata

    want = {i: "".join(c for c in unicodedata.normalize("NFKD", w) if unicodedata.category(c) != "Mn") for i, w in enumerate(words)}
    assert {r.i: r.f for r in df.select("i", T.fold("s").alias("f")).collect()} == want | {99: None}


def test_components_of_a_giant_star_with_numbers(spark, monkeypatch):
    monkeypatch.setattr(ties, "HOT_NODES", 20)
    pairs = [(1000, i) for i in range(300)] + [(i, 2000 + i) for i in range(0, 300, 7)] + [(5000, 5001)]
    got = {r.node: r.root for r in ties.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got[5001] == 5000 and {v for k, v in got.items() if k < 5000} == {0} and len(got) == 301 + 43 + 2
