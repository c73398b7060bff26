import json
from datetime import datetime

from pyspark.sql import functions as F

from knowgrid.operators import identity
from knowgrid.sources import records as R
from knowgrid.streaming import flows


def test_org_chart_by_heading_synonyms(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Full Name,E-Mail Address,Department,Reports To,Skills\n"Doe, Ann",Ann+x@A.example,Pay,bob@a.example,billing; retries;\n,,Pay,,\n')
    r = R.org_chart(spark, str(tmp_path / "p.csv")).collect()
    assert len(r) == 1 and (r[0].name, r[0].email, r[0].team, r[0].manager, r[0].topics) == ("Doe, Ann", "ann@a.example", "Pay", "bob@a.example", ["billing", "retries"])


def test_time_entries(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Timekeeper Email,Timekeeper,Matter,Practice Area,Narrative,Date\na@x.example,Ann,Acme merger,Tax Law,Review of escrow terms,2024-01-05\na@x.example,Ann,Acme merger,Tax Law,Call,1/9/2023\n")
    r = R.time_entries(spark, str(tmp_path / "m.csv"), "2024-02-01").first()
    assert r.person_id == "a@x.example" and r.topics.count("tax-law") == 2 and r.recent_topics.count("tax-law") == 1 and "escrow" in r.weak_topics and r.time == datetime(2024, 1, 5)


def test_owners_file(spark, tmp_path):
    (tmp_path / "OWNERS").write_text("# comment\n[section] @x\n/billing/ @Acme/Pay ann@a.example # tail\n*.tf @ops\n")
    got = {r.person_id: r.topics for r in R.owners(spark, str(tmp_path / "OWNERS")).collect()}
    assert got == {"codeowners:acme/pay": ["billing"], "ann@a.example": ["billing"], "codeowners:ops": ["terraform"]}


def test_json_import_and_sink(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"kind": "person", "name": "Ann", "source": "a", "text": "Billing retries, billing"}, {"kind": "person", "name": "Bob", "source": "b"}]))
    r = R.import_json(spark, str(tmp_path / "r.json"))
    R.write_records(r, str(tmp_path / "store"))
    R.write_records(r.where("source = 'a'").withColumn("name", F.lit("Ann B")), str(tmp_path / "store"))
    got = {x.source: (x.name, x.terms) for x in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {"a": ("Ann B", ["bill", "retri"]), "b": ("Bob", None)}
    assert "text" not in spark.read.parquet(str(tmp_path / "store")).columns


def test_commits_and_trailers(spark):
    rows = [("h1", "a@x.example", 1, ["src/billing/retry.go", "src/billing/queue.go"], ["b@x.example"]), ("h2", "a@x.example", 2, ["docs/x.md"], None), ("h3", "a@x.example", 1, [f"d{i}/ledger.go" for i in range(30)], None)]
    c = spark.createDataFrame(rows, "hash string, email string, parents int, paths array<string>, co_authors array<string>").withColumn("authored_at", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.email, r.topic): (r.commits, r.direct) for r in R.commit_work(c).collect()}
    assert got[("a@x.example", "billing")] == (1, 1) and got[("b@x.example", "billing")] == (1, 1) and got[("a@x.example", "ledger")] == (1, 0) and got[("a@x.example", "golang")] == (2, 1)
    dirs = {(r.place, r.person): r.n for r in R.dir_work(c).collect()}
    assert dirs[("src/billing", "a@x.example")] == 1 and dirs[("src", "a@x.example")] == 1
    m = spark.createDataFrame([("Fix\n\nCo-authored-by: Bob B <B@x.example>\nSigned-off-by: C <c@x.example>\nreviewed-by: D <d@x.example>",)], "m string")
    assert [(t.kind, t.name, t.email) for t in m.select(R.trailers(F.col("m")).alias("t")).first().t] == [("co-authored-by", "Bob B", "b@x.example"), ("reviewed-by", "D", "d@x.example")]


def test_mailmap(spark):
    mm = spark.createDataFrame([("Ann Doe", "ann@a.example", None, "old@a.example"), ("Bob", "bob@a.example", "B", "old@a.example")], "proper_name string, proper_email string, commit_name string, commit_email string")
    rows = spark.createDataFrame([("x", "OLD@a.example"), ("b", "old@a.example"), ("z", "z@a.example")], "name string, email string")
    assert {tuple(r) for r in R.mailmap_resolve(rows, mm).collect()} == {("Ann Doe", "ann@a.example"), ("Bob", "bob@a.example"), ("z", "z@a.example")}


def test_chat_export(spark, tmp_path):
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "ann", "profile": {"real_name": "Ann Doe", "email": "Ann@a.example", "title": "Eng"}}, {"id": "U2", "name": "bob", "profile": {"real_name": "Bob", "email": None, "title": None}}]))
    (tmp_path / "pay").mkdir()
    (tmp_path / "pay" / "2024-01-01.json").write_text(json.dumps([{"user": "U1", "ts": "1704067200.1", "text": "token=abcdef99 billing"}, {"user": "U2", "ts": "1704067300.1", "text": "ok"}]))
    got = {(r.kind, r.person_id or r.name): r for r in R.chat_export(spark, str(tmp_path)).collect()}
    assert got[("person", "ann@a.example")].text == "token=[redacted] billing" and got[("person", "slack:u2")].name == "Bob"
    assert got[("channel", "pay")].members == ["ann@a.example", "slack:u2"]


def test_issues_and_oncalls(spark):
    i = spark.createDataFrame([("a", "b", ["Billing"], ["k8s"], "PAY", "Slow ledger export"), ("a", None, None, None, "PAY", None)], "assignee string, reporter string, components array<string>, labels array<string>, project string, summary string")
    got = {(r.person, r.topic, r.stated): r.n for r in R.issues(i).collect()}
    assert got[("a", "pay", False)] == 2 and got[("b", "kubernetes", True)] == 1 and got[("a", "ledger-export", False)] == 1
    s, o = spark.createDataFrame([("p", "Ledger writer")], "policy string, service string"), spark.createDataFrame([("p", "a"), ("q", "b")], "policy string, person string")
    assert {tuple(r) for r in R.oncall_topics(s, o).collect()} == {("a", "ledger"), ("a", "writer")}


def test_identity_passes_and_representatives(spark):
    rows = [
        ("ann.doe@a.example", "Ann Doe", "ann.doe@a.example"), ("bob@solo.example", "Bob Rovnypald", "bob@solo.example"), ("cy@a.example", "Cy Quillatsson", "cy@a.example"), ("di@a.example", "Di Quillatsson", "di@a.example"),
        ("chat:anndoe", "x", None), ("git:solo", "x", None), ("git:bobrovnypaldx", "x", None), ("git:quillatsson", "x", None), ("git:cquillatsson", "x", None), ("git:nobody", "x", None),
    ]
    people = spark.createDataFrame(rows, "id string, name string, email string")
    got = {r.alias: (r.canonical, r.reason) for r in identity.infer(people).collect()}
    assert got == {
        "chat:anndoe": ("ann.doe@a.example", "unique name match"), "git:solo": ("bob@solo.example", "email domain label"), "git:bobrovnypaldx": ("bob@solo.example", "name prefix"), "git:cquillatsson": ("cy@a.example", "initial and surname"),
    }
    edges = spark.createDataFrame([("git:x", "x"), ("x", "x@a.example"), ("jira:y", "y")], "a string, b string")
    assert {r.alias: r.canonical for r in identity.aliases(edges).collect()} == {"git:x": "x@a.example", "x": "x@a.example", "x@a.example": "x@a.example", "jira:y": "y", "y": "y"}
    ids = spark.createDataFrame([("a", "support@a.example", ["git:a", None]), ("b", "b@a.example", None)], "id string, email string, alt_ids array<string>")
    assert {tuple(r) for r in identity.explicit_edges(ids).collect()} == {("a", "git:a"), ("b", "b@a.example")}


def test_addresses_of_one_person_are_joined(spark):
    rows = [("ann.doe@a.example", "Ann Doe"), ("anndoe@b.example", "ann doe"), ("ann.doe@c.example", "Ann Dowell"), ("mike@a.example", "Mike"), ("mike@b.example", "Mike")]
    people = spark.createDataFrame([(a, n, a) for a, n in rows], "id string, name string, email string")
    assert [tuple(r) for r in identity.infer(people).collect()] == [("anndoe@b.example", "ann.doe@a.example", 0.85, "matching email variant")]


def test_streams(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:20:00"), (2, 7, "2024-01-01 00:20:00"), (3, 7, "2024-01-01 02:00:00"), (4, 8, "2024-01-02 00:00:00"), (5, 9, "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = flows.event_stream(spark, str(tmp_path / "in"), "event_id long, user_id long, ts timestamp")
    got = []
    flows.run_available(flows.session_counts(s), str(tmp_path / "c1"), lambda b, _: got.extend(b.collect()))
    assert sorted((r.user_id, r.n) for r in got) == [(7, 1), (7, 3), (8, 1)]
    seen = []
    flows.run_available(flows.once(s), str(tmp_path / "c2"), lambda b, _: seen.extend(r.event_id for r in b.collect()))
    assert sorted(seen) == [1, 2, 3, 4, 5]
    fold = flows.fold_batch(str(tmp_path / "fold"), "user_id", "ts")
    for _ in range(2):
        fold(df, 0)
    fold(spark.createDataFrame([(9, 7, "2023-01-01")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts")), 1)
    assert sorted((r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "fold")).collect()) == [(7, 3), (8, 4), (9, 5)]
