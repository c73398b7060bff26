import json

from pyspark.sql import functions as F

from knowgrid.functions import words as W
from knowgrid.plans.assess import assess
from knowgrid.sources import changes, store


def test_assessment_and_report(spark, tmp_path):
    pt = spark.createDataFrame([("a", "x", 9.0, 0.0, 9.0), ("b", "x", 1.0, 0.0, 1.0), ("b", "y", 5.0, 0.0, 5.0), ("c", "y", 5.0, 0.0, 5.0)], "person string, topic string, w double, stated double, direct double")
    dec = spark.createDataFrame([("x", "b"), ("y", "b")], "topic string, owner string")
    places = spark.createDataFrame([("src", "a", 3), ("src", "b", 1)], "place string, person string, n int")
    links = spark.createDataFrame([("x", "y", 0.5, 1, "a"), ("y", "x", 0.5, 1, "a")], "a string, b string, weight double, witnesses int, sole string")
    found = assess(pt, dec, places, links)
    assert {r.topic: r.level for r in found["risks"].collect()} == {"x": "critical", "y": "elevated"}
    assert {(r.person, r.topic) for r in found["departures"].collect()} == {("a", "x"), ("c", "y")}
    assert {r.topic: r.standing for r in found["owned_areas"].collect()} == {"x": "trailing", "y": "held"}
    assert [(r.person, r.a, r.b) for r in found["spans"].collect()] == [("a", "x", "y")]
    assert found["places"].first().holder == "a" and found["counts"].first().critical == 1
    store.write_report({"risks": found["risks"]}, str(tmp_path / "report"))
    lines = [json.loads(x) for f in (tmp_path / "report" / "risks").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["topic"] for x in lines} == {"x", "y"}
    store.save({"tie": links, "counts": found["counts"]}, str(tmp_path / "index"))
    assert store.load(spark, str(tmp_path / "index"), "tie").count() == 2


def test_changes_and_pages(spark):
    c = spark.createDataFrame([(1, "ann", ["bob"], None, ["dependabot", "bob"], ["K8s"], "Fix ledger export")], "id long, author string, reviewers array<string>, assignees array<string>, helpers array<string>, labels array<string>, title string")
    got = {(r.person, r.topic, r.stated): r.n for r in changes.change_topics(c).collect()}
    assert got[("ann", "kubernetes", True)] == 1 and got[("bob", "ledger-export", False)] == 1 and not any(p == "dependabot" for p, _, _ in got)
    m = spark.createDataFrame([(1, "ann", ["bob"], None, True), (2, "cy", None, None, False)], "id long, author string, requested array<string>, assignees array<string>, merged boolean")
    said = spark.createDataFrame([(1, "ann"), (1, "bob"), (1, "dee"), (1, "dee"), (2, "eve")], "id long, person string")
    assert [tuple(r) for r in changes.helpers(m, said).collect()] == [(1, "dee")]
    p = spark.createDataFrame([("ann", "ann", ["Billing"], "Ledger runbook", "PAY", "retries pile up")], "created_by string, edited_by string, labels array<string>, title string, space string, body string")
    got = {(r.person, r.topic, r.stated): r.n for r in changes.page_topics(p).collect()}
    assert got[("ann", "billing", True)] == 1 and got[("ann", "retries", False)] == 1 and got[("ann", "pay", False)] == 1
    t = spark.createDataFrame([("bug", "ledger"), ("ledger", "export")], "a string, b string")
    assert changes.process_free(t, W.PROCESS_LABELS).count() == 1


def test_directory_and_bundle(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"mail": "Ann@a.example", "userPrincipalName": "ann.d@corp.example", "displayName": "Ann", "manager": "Bob@a.example"}\n{"userPrincipalName": "x@corp.example"}\n')
    got = {r.person_id: (r.alt_ids, r.manager) for r in changes.directory_users(spark, str(tmp_path / "u.json")).collect()}
    assert got == {"ann@a.example": (["ann.d@corp.example"], "bob@a.example"), "x@corp.example": ([], None)}
    f = spark.createDataFrame([("who knows billing", 1, "2024-01-01"), ("a b c", 1, "2024-01-01")], "query string, vote int, time string").withColumn("time", F.to_timestamp("time"))
    assert [(r.words, r.vote, r.n) for r in store.redacted_bundle(f).collect()] == [(3, 1, 2)]
