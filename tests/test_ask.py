import pytest
from pyspark.sql import functions as F

from knowgrid.functions.stem import stem
from knowgrid.operators import ask, knowledge
from knowgrid.operators import conversations as C

PEOPLE = {"ann": ["billing", "retries", "ledger"], "bob": ["billing"], "cyd": ["invoices", "taxes"], "dee": ["search"], "eve": ["queues"]}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(p, stem(t), 3.0, t) for p, ts in PEOPLE.items() for t in ts] + [("dee", "bill", 0.5, "billing")]
    df = spark.createDataFrame(rows, "entity string, token string, w double, value string")
    fields = df.select("entity", F.when(F.col("w") > 1, "topic").otherwise("mention").alias("field"), "token", "value")
    return df.groupBy("entity", "token").agg(F.sum("w").alias("w")), fields


def test_ask_ranks_and_explains(spark, tables):
    post, fields = tables
    got = ask.ask(spark, "Who do I talk to about billing retries?", post, fields).orderBy("rank").collect()
    by = {r.entity: r for r in got}
    assert got[0].entity == "ann" and got[0].strength == 1.0 and got[0].label == "strong"
    assert got[0].reasons == ["topic billing", "topic retries"] and by["bob"].strength == 0.5
    assert by["cyd"].reasons == ["topic invoices, for invoices"] and by["dee"].reasons == ["mention billing"]
    assert by["bob"].score > by["dee"].score
    assert ask.ask(spark, "who owns the", post, fields).count() == 0


def test_typos_votes_and_ties(spark, tables):
    post, fields = tables
    got = {r.entity: r for r in ask.ask(spark, "ledgr", post, fields).collect()}
    assert got["ann"].reasons == ["topic ledger, read for ledgr"]
    votes = spark.createDataFrame([("bob", ["bill"], 3), ("ann", ["bill"], -3), ("ann", ["zzz"], 3)], "entity string, rule array<string>, vote int")
    assert ask.ask(spark, "billing", post, fields, votes=votes).orderBy("rank").first().entity == "bob"
    ties = spark.createDataFrame([("ledger", "queue", 0.5), ("ledger", "search", 0.001)], "a string, b string, weight double")
    got = {r.entity: r.strength for r in ask.ask(spark, "ledger", post, fields, ties=ties).collect()}
    assert got == {"ann": 1.0, "eve": 0.0}


def test_hybrid_and_recall(spark):
    named = spark.createDataFrame([("z", 1.0)], "id string, strength double")
    a, b = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "entity string, score double"), spark.createDataFrame([("y", 9.0)], "entity string, score double")
    assert [r.entity for r in ask.hybrid(named, [a, b]).orderBy("rank").collect()] == ["z", "y", "x"]
    part = spark.createDataFrame([(1, "me"), (1, "you"), (2, "you")], "episode long, person string")
    found = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.9, 1.0)], "episode long, score double, strength double")
    r = ask.recall(found, part, found, "me").collect()
    assert [(x.episode, x.others) for x in r] == [(1, ["you"])]
    with pytest.raises(ValueError):
        ask.recall(found, part, found, None)


def test_topic_groups_and_families(spark):
    h = spark.createDataFrame([("bill", p) for p in "abc"] + [("bill-run", p) for p in "ab"] + [("bill-run-eu", p) for p in "ab"] + [("run", "z")], "topic string, person string")
    assert {r.topic: r.grp for r in knowledge.topic_groups(h).collect()} == {"bill": "bill-run-eu", "bill-run": "bill-run-eu", "bill-run-eu": "bill-run-eu", "run": "run"}
    r = spark.createDataFrame([("g", "zwave_js", 3), ("g", "zwave", 2), ("g", "mqtt", 1)], "grp string, n string, s int")
    assert [(x.pos, x.n) for x in knowledge.collapse_family(r, "grp", "n", [F.desc("s")]).orderBy("pos").collect()] == [(1, "zwave_js"), (2, "mqtt")]


def test_threads(spark):
    rows = [("c", "1", "1", "ann", "q"), ("c", "2", "1", "bob", "a1"), ("c", "3", "1", "ann", "a2"), ("c", "4", None, "cy", "x"), ("c", "5", "1", "dee", "a3")]
    m = spark.createDataFrame(rows, "channel string, ts string, thread_ts string, user string, text string")
    p = C.repair_threads(m)
    assert {r.ts: (r.replies, r.repliers, r.last_reply) for r in p.collect()} == {"1": (3, ["ann", "bob", "dee"], "5"), "4": (0, None, None)}
    e = {r.ts: (r.participants, r.body) for r in C.enrich_threads(p.select("channel", "ts", "user", "text"), m, 2).collect()}
    assert e == {"1": (["ann", "bob"], "q\na1\na2"), "4": (["cy"], "x")}


def test_lookups(spark):
    p = spark.createDataFrame([("b", "Ann Doe", "x@a.example"), ("a", "ann doe", "y@a.example")], "id string, name string, email string")
    assert knowledge.find_person(p, "ANN DOE").first().id == "a" and knowledge.find_person(p, "x@a", fuzzy=True).first().id == "b" and knowledge.find_person(p, "zz").count() == 0
    assert knowledge.matching(p, id=None).count() == 0 and knowledge.matching(p, id="A").count() == 1
    common = spark.createDataFrame([("u", f"p{i}", t, t == "energy") for i in range(2) for t in ("services", "energy", f"t{i}")], "unit string, path string, topic string, deep boolean")
    assert [r.topic for r in knowledge.common_to_all(common).collect()] == ["services"]
