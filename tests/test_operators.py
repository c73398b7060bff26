import math

import pytest
from pyspark.sql import functions as F

from knowgrid.functions import text as T
from knowgrid.functions.identity import normalize_email
from knowgrid.functions.stem import stem
from knowgrid.operators import episodes, risk, search, ties, vectors


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("flies", "fli"), ("agreed", "agre"), ("sized", "size"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("billing", "bill"), ("skies", "sky"), ("a", "a")],
)
def test_stem(word, want):
    assert stem(word) == want
    assert stem(stem(want)) == stem(want)


@pytest.mark.parametrize(
    ("address", "want"),
    [(" Ann+x@A.example ", "ann@a.example"), ("Ann <Ann.B@c.example>", "ann.b@c.example"), ("12+ann@users.noreply.forgehub.example", "12+ann@users.noreply.forgehub.example"), ("n/a", "n/a"), (None, None)],
)
def test_email(spark, address, want):
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(normalize_email(F.col("a"))).first()[0] == want


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("Who owns the José-Café billing, please?"))) == ["josé", "café", "billing"]
    assert one(spark, T.fold(F.lit("José ﬁ"))) == "Jose fi"
    assert one(spark, T.topic_id(F.lit(" K8s "))) == "kubernetes"
    assert one(spark, T.phrase_tokens(F.lit("Fix billing retries now"))) == ["billing", "retries", "now", "billing-retries", "retries-now"]
    assert one(spark, T.fold_group_name(F.lit("Store-Admin"))) == "store"
    assert one(spark, T.path_topics(F.lit("src/billing_core/retry.tf"))) == ["terraform", "billing_core", "billing", "retry"]
    assert one(spark, T.truncate_bytes(F.lit("aéé"), 4)) == "aé"
    clean, n = T.scrub(F.lit("password=hunter22 and Bearer abcdefghijklmnopqrst; my token expired"))
    assert one(spark, clean) == "password=[redacted] and Bearer [redacted]; my token expired"
    assert one(spark, n) == 2
    assert one(spark, T.is_automation(F.lit("Talbot"), F.lit("talbot@a.example"))) is False
    assert one(spark, T.is_automation(F.lit("X MergeBot"), F.lit("x@a.example"))) is True
    assert [one(spark, T.topic_repeat(F.lit(n))) for n in (3, 4, 8, 10_000)] == [3, 4, 7, 16]


def test_score_by_hand(spark):
    post = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 1.0), ("c", "z", 8.0)], "entity string, token string, w double")
    terms = spark.createDataFrame([("x", 1.0, "x"), ("y", 0.8, "q")], "token string, penalty double, covers string")
    got = {r.entity: r for r in search.score(post, terms).collect()}
    avg = (4 + 1 + 8) / 3
    norm = min(1.75, max(1, 0.25 + 0.75 * 4 / avg))
    want = (1 + math.log(3 / 2)) * 3 * 2.2 / (3 + 1.2 * norm) + 0.8 * (1 + math.log(3)) * 2.2 / (1 + 1.2 * norm)
    assert got["a"].score == pytest.approx(want) and got["a"].covered == 1 and got["b"].covered == 0.5 and "c" not in got


def test_fuzzy_and_synonyms(spark):
    v = spark.createDataFrame([("billing", 3), ("filling", 5), ("retries", 2)], "token string, df int")
    asked = spark.createDataFrame([("biling",), ("retries",), ("zzz",)], "term string")
    got = {r.term: (r.token, r.dist) for r in search.resolve_terms(asked, v).collect()}
    assert got == {"biling": ("billing", 1), "retries": ("retries", 0)}
    terms = search.expand_synonyms(["time", "off"], (("vacation", "pto", "time off"),))
    assert ("vacation", 0.8, "time") in terms and ("time", 1.0, "time") in terms


def test_bus_factor_on_the_edge(spark):
    pt = spark.createDataFrame([("p", "t", 8.0), ("q", "t", 2.0), ("p", "u", 5.0), ("q", "u", 5.0), ("r", "v", 1.0)], "person string, topic string, w double").withColumn("stated", F.lit(0.0))
    got = {r.topic: (r.experts, r.bus) for r in risk.bus_factor(pt).collect()}
    assert got == {"t": (2, 1), "u": (2, 2), "v": (1, 1)}
    assert {r.topic: r.level for r in risk.risk(pt).collect()} == {"t": "critical", "u": "elevated", "v": "critical"}


def test_owned_areas(spark):
    pt = spark.createDataFrame([("a", "x", 9.0, 0.0, 3.0), ("b", "x", 9.0, 0.0, 9.0), ("a", "y", 3.0, 0.0, 3.0), ("c", "z", 3.0, 0.0, 3.0)], "person string, topic string, w double, stated double, direct double")
    dec = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "a"), ("z", "nobody"), ("empty", "a")], "topic string, owner string")
    got = {r.topic: (r.standing, r.actual, r.owners) for r in risk.owned_areas(dec, pt).collect()}
    assert got == {"x": ("trailing", "b", ["a"]), "y": ("held", "a", ["a"]), "z": ("unworked", "c", ["a", "nobody"])}
    lone = spark.createDataFrame([("z", "nobody")], "topic string, owner string")
    assert [r.standing for r in risk.owned_areas(lone, pt).collect()] == ["silent"]
    report = risk.ownership_report(risk.owned_areas(dec, pt)).first()
    assert (report.declared, report.held, report.trailing, report.unworked, report.share) == (3, 1, 1, 1, 0.666667)


def test_areas_of_groups(spark):
    pt = spark.createDataFrame([("a", t, 9.0, 0.0, 9.0) for t in ("x", "y", "z", "v")] + [("b", "x", 6.0, 0.0, 6.0)], "person string, topic string, w double, stated double, direct double")
    dec = spark.createDataFrame([("x", "owners:acme/alerts-squad"), ("y", "owners:acme/twins-team"), ("z", "owners:renovate-bot"), ("v", "owners:acme/alerts-squad"), ("v", "talbot")], "topic string, owner string")
    teams = spark.createDataFrame([(1, "Alerts"), (2, "Twins"), (3, "twins group"), (4, "")], "team int, name string")
    known = risk.squad_teams(dec, teams, ("squad", "team", "group"))
    assert [tuple(r) for r in known.collect()] == [("owners:acme/alerts-squad", 1)]
    squads = known.select("owner").crossJoin(spark.createDataFrame([("b",)], "person string"))
    got = {r.topic: (r.standing, r.actual) for r in risk.owned_areas(dec, pt, squads).collect()}
    assert got == {"x": ("trailing", "a"), "y": ("group", None), "z": ("group", None), "v": ("silent", "a")}
    assert risk.ownership_report(risk.owned_areas(dec, pt, squads)).first().share == 1.0


def test_stated_weight_is_no_work_and_ranks_keep_their_tail(spark):
    pt = spark.createDataFrame([("a", "x", 9.0, 9.0), ("b", "x", 4.0, 1.0)], "person string, topic string, w double, stated double")
    assert [r.person for r in risk.leaders(pt).collect()] == ["b"]
    scored = spark.createDataFrame([(f"e{i:03}", float(200 - i), 1.0) for i in range(100)], "entity string, score double, covered double")
    ev = spark.createDataFrame([("e063", "topic"), ("e064", "topic")], "entity string, field string")
    got = {r.entity: (r.score, r["head"]) for r in search.rerank(scored, ev).collect()}
    assert len(got) == 100 and got["e063"] == (137.0 * 1.3, True) and got["e064"] == (136.0, False)


def test_ties_and_regions(spark):
    rows = [(u, t, f"w{u % 2}") for u in range(8) for t in ("a", "b", "c")] + [(100 + u, t, "z") for u in range(6) for t in ("d", "e")]
    work = spark.createDataFrame(rows + rows, "unit long, topic string, who string")
    t = ties.weigh(ties.cooccurrence(work), work)
    got = {(r.a, r.b): (r.weight, r.witnesses, r.sole) for r in t.collect()}
    assert got[("a", "b")] == (1.0, 2, None) and got[("e", "d")] == (1.0, 1, "z") and len(got) == 8
    lead = spark.createDataFrame([(x, "p") for x in "abcde"], "topic string, person string")
    assert {(r.region, r.topic) for r in ties.regions(t, lead).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    assert {(r.person, r.a, r.b) for r in ties.sole_spans(t).collect()} == {("z", "d", "e")}


def test_components_on_a_long_path(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in ties.components(e).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 123


def test_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 4)) for r in vectors.nearest(e, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 0.7071)]
    q, s = vectors.quantise(F.col("embedding"))
    assert [list(r.q) for r in e.where("vec_id in (3, 4)").orderBy("vec_id").select(q.alias("q")).collect()] == [[127, 127], [0, 0]]


def test_sessions_split_beyond_the_gap(spark):
    ev = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:30:00"), (3, 7, "2024-01-01 01:00:01")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.session for r in episodes.sessions(ev, "user_id", "ts").orderBy("event_id").collect()] == [1, 1, 2]


def test_upsert_keeps_what_the_new_run_lacks(spark):
    old = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k long, v string, archive string")
    new = spark.createDataFrame([(1, "c", None), (3, "d", "new")], "k long, v string, archive string")
    assert {tuple(r) for r in episodes.upsert(old, new, "k", ("archive",)).collect()} == {(1, "c", "old"), (2, "b", "old"), (3, "d", "new")}
