"""The identity passes on small fixtures: who is joined, and who must stay apart."""

from knowgrid.operators import identity as I

SCHEMA = "id string, name string, email string"


def people(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[0] if len(r) < 3 else r[2]) for r in rows], SCHEMA)


def topics(spark, **who):
    return spark.createDataFrame([(i, t) for i, ts in who.items() for t in ts.split()], "id string, topic string")


def pairs(df):
    return sorted((r.alias, r.canonical) for r in df.collect())


def test_ambiguous_handles_are_settled_by_team_or_topics(spark):
    known = spark.createDataFrame([("a@x.example", "Jo Doe", "a@x.example", "pay"), ("b@x.example", "Jo Doe", "b@x.example", "ops"), ("c@x.example", "Al Roe", "c@x.example", ""), ("d@x.example", "Al Roe", "d@x.example", "")], SCHEMA + ", team string")
    handles = spark.createDataFrame([("chat:jodoe", "pay"), ("chat:alroe", ""), ("git:al-roe", "")], "id string, team string")
    t = spark.createDataFrame([("chat:alroe", "x"), ("chat:alroe", "y"), ("d@x.example", "x"), ("d@x.example", "y"), ("c@x.example", "x")], "id string, topic string")
    got = sorted((r.alias, r.canonical, r.confidence) for r in I.pass_flat_name(handles, known, t).collect())
    assert got == [("chat:alroe", "d@x.example", 0.7), ("chat:jodoe", "a@x.example", 0.8)]


def test_same_name_needs_two_people_and_three_subjects(spark):
    p = people(spark, [("a@x.example", "Ann Doe"), ("b@y.example", "ann doe "), ("c@x.example", "Bob Roe"), ("d@y.example", "Bob Roe"), ("e@z.example", "Bob Roe"), ("f@x.example", "Cy"), ("g@x.example", "Cy"), ("h@x.example", None)])
    t = topics(spark, **{i: "k l m n" for i in ("a@x.example", "c@x.example", "d@y.example", "e@z.example", "f@x.example", "g@x.example")}, **{"b@y.example": "l m n"})
    assert pairs(I.pass_same_name(p, t)) == [("b@y.example", "a@x.example")]
    assert pairs(I.pass_same_name(p, t.where("topic <> 'm'"))) == []
    assert pairs(I.pass_same_name(p.limit(0), t)) == []


def test_same_surname_needs_a_private_address(spark):
    t = "k l m"
    p = people(spark, [("1+ag@users.noreply.forgehub.example", "A Gorvald"), ("anna@x.example", "Anna Gorvald"), ("b@x.example", "B Tarvest"), ("c@x.example", "C Tarvest"), ("2+s@users.noreply.forgehub.example", "S Smith"), ("t@x.example", "T Smith"), ("3+q@users.noreply.forgehub.example", "Q Elvorn"), ("r@x.example", "R Elvorn"), ("s@x.example", "Relvorn")])
    ids = [r.id for r in p.collect()]
    assert pairs(I.pass_same_surname(p, topics(spark, **{i: t for i in ids}))) == [("anna@x.example", "1+ag@users.noreply.forgehub.example")]


def test_same_mailbox_at_two_domains(spark):
    rows = [("bw.plot@x.example", "Bart W"), ("bwplot@y.example", "BP"), ("maria@x.example", "Maria Roe"), ("maria@y.example", "M. Poe"), ("admin@x.example", "Ad Min"), ("admin@y.example", "Ad Min"), ("zoltanx@x.example", "Zoltan"), ("zoltanx@y.example", "zoltan")]
    p = people(spark, rows)
    assert pairs(I.pass_same_local(p, topics(spark, **{i: "k l m" for i, _ in rows}))) == [("bwplot@y.example", "bw.plot@x.example")]


def test_display_name_is_a_login(spark):
    p = people(spark, [("9+zed42@users.noreply.forgehub.example", "Zed Roe"), ("z@x.example", "zed42"), ("8+twin@users.noreply.forgehub.example", "T"), ("u@x.example", "twin"), ("v@x.example", "Twin")])
    assert pairs(I.pass_login_name(p)) == [("z@x.example", "9+zed42@users.noreply.forgehub.example")]


def test_mailboxes_that_spell_one_name(spark):
    rows = [("ann.kerval@x.example", "Ann Kerval"), ("kervalann@y.example", "Ann Kerval"), ("bobroemer@x.example", "Bob Roemer"), ("bobroemer7@y.example", "Bob Roemer"), ("maxtorv@x.example", "Maximilian Torvald"), ("maximtorvald@y.example", "Maximilian Torvald"),
            ("dan.oak@x.example", "Dan Oak"), ("info77@y.example", "Dan Oak"), ("alexander.brandt@x.example", "Alexander Brandt"), ("alexbrandt@y.example", "Alexander Brandt")]
    assert pairs(I.pass_same_name_mailboxes(people(spark, rows))) == [("alexbrandt@y.example", "alexander.brandt@x.example"), ("bobroemer@x.example", "bobroemer7@y.example"), ("kervalann@y.example", "ann.kerval@x.example")]


def test_the_ledger_uses_earlier_joins_and_is_pruned(spark):
    p = people(spark, [("chat:alroe", "alroe", None), ("ann.kerval@x.example", "Ann Kerval"), ("kerval.ann@y.example", "Ann Kerval"), ("al@x.example", "Al Roe")])
    led = I.infer(p)
    assert pairs(led) == [("chat:alroe", "al@x.example"), ("kerval.ann@y.example", "ann.kerval@x.example")]
    old = spark.createDataFrame([("chat:alroe", "gone@x.example", 0.9, "old"), ("chat:al", "al@x.example", 0.8, "old"), ("chat:x", "gone@x.example", 0.8, "old")], led.schema)
    assert pairs(I.merge_ledger(old, led, p)) == [("chat:al", "al@x.example"), ("chat:alroe", "al@x.example"), ("kerval.ann@y.example", "ann.kerval@x.example")]
