import random

from knowgrid.llm import names as N

PEOPLE = [(g, s) for g in ("anna", "bjorn", "corinna", "dominik") for s in ("falmalescu", "berquaham", "torvezley", "lundinberg", "haltapald")]
ROWS = [(f"{g.title()} {s.title()}", f"{g}.{s}@corp.example") for g, s in PEOPLE] * 2 + [(f"Corrie {s.title()}", f"corinna.{s}@corp.example") for _, s in PEOPLE[:5]]
HABITS = N.Habits(ROWS)


def _distance(a, b):
    """Plain edit distance with swaps of neighbours."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_agrees_with_edit_distance():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(0, 8))) for _ in range(300)})
    trie = N.Trie()
    for w in words:
        trie.add(w, w)
    for _ in range(150):
        q = "".join(rng.choices("abc", k=rng.randrange(0, 8)))
        for k in (1, 2):
            got = sorted((d, v) for d, v in trie.near(q, k))
            assert got == sorted((_distance(q, w), w) for w in words if _distance(q, w) <= k)
            assert all(N.within(q, w, k) == (_distance(q, w) <= k) for w in words[:40])


def test_tokens_and_habits():
    assert N.name_tokens("[EXT] Falmаlescu, Anna - on leave") == ["anna", "falmalescu"]
    assert N.name_tokens("TorvezleyBjörn") == ["torvezley", "bjorn"]
    assert N.name_tokens('D1ego "Dee" Tolnezl3y, PhD')[-1] == "tolnezley"
    assert HABITS.givens("corrie") == {"corinna"} and HABITS.givens("dominick") == {"dominik"}
    assert N.parse_local("lundinberg.anna", [], HABITS)[:2] == ("lundinberg", "anna")
    assert N.parse_local("annalundinberg", [], HABITS)[:2] == ("lundinberg", "anna")
    assert N.parse_local("blundinberg77", ["bjorn", "lundinberg"], HABITS) == ("lundinberg", "b", "77")


def groups(spark, rows):
    df = spark.createDataFrame(rows, "rec_id long, name string, email string, title string, team string, org string, manager string")
    out = {}
    for r in N.link_names(df, HABITS).collect():
        out.setdefault(r.group_id, set()).add(r.rec_id)
    return sorted(map(sorted, out.values()))


def test_links_variants_and_parts_namesakes(spark):
    sig = ("Eng", "Pay", "Data", None)
    rows = [
        (1, "Anna Falmalescu", "anna.falmalescu@corp.example", *sig),
        (2, "Falmalescu, A.", "Anna.Falmalescu+x@corp.example", "eng", "Pay ", "Data", None),
        (3, "Ana Falmalesku", None, *sig),
        (4, "Anna Falmalescu", "afalmalescu55@home.example", *sig),
        (5, "Anna Falmalescu", "anna.falmalescu2@corp.example", "Counsel", "Legal", "Ops", None),
        (6, "Bjorn Berquaham", "bjorn.berquaham@corp.example", None, None, None, None),
        (6, "Berquaham B", "12+bjorn-berquaham@users.noreply.forgehub.example", None, None, None, None),
        (7, "Bjorm Berquahma", None, None, None, None, None),
        (8, "The Quorvanehevnuberi Sys. GmbH", "info@quorvanehevnuberi.example", None, None, None, None),
        (9, "QUORVANEHEVNUBRI SYSTEMS", "n/a", None, None, None, None),
        (10, None, None, None, None, None, None),
        (11, "???", "unknown", "Eng", "Pay", "Data", None),
        (12, "Corrie Torvezley", "x" * 3000, *sig),
        (12, "Corrie Torvezley", "x" * 3000, *sig),
        (13, "Corinna Torvezley", "corinna.torvezley@corp.example", *sig),
    ]
    assert groups(spark, rows) == [[1, 2, 3, 4], [5], [6, 7], [8, 9], [10], [11], [12, 13]]


def test_pairs_and_empty(spark):
    df = spark.createDataFrame([(3, "g"), (1, "g"), (2, "g"), (9, "h")], "rec_id long, group_id string")
    assert sorted(tuple(r) for r in N.same_entity_pairs(df).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert groups(spark, []) == []


def test_typed_names_count_beside_addresses(spark):
    none = (None, None, None, None)
    rows = [
        (1, "Anna Falmalescu", "anna.falmalescu@corp.example", *none),
        (2, "Ana Falmalesku", "sunnyday@home.example", *none),
        (3, "Bjorn Berquaham", "bjorn.berquaham@corp.example", *none),
        (4, "Dominik Haltapald", "bjorn-berquaham@home.example", *none),
        (5, "Dominik Haltapald", "dominik.haltapald@corp.example", *none),
    ]
    assert groups(spark, rows) == [[1, 2], [3, 4], [5]]


def _edited(rng, w, ends):
    """``w`` with an edit (two, one near each end, for ``ends``), and never two of one kind at one place."""
    def once(x, lo, hi):
        i, c = rng.randrange(lo, hi), rng.choice("abcdefghijklmnopqrstuvwxyz")
        return rng.choice([x[:i] + x[i + 1 :], x[:i] + c + x[i:], x[:i] + c + x[i + 1 :], x[:i] + x[i + 1 : i + 2] + x[i : i + 1] + x[i + 2 :]])

    return once(once(w, 0, 2), len(w) - 1, len(w)) if ends else once(w, 0, len(w))


def test_trie_join_finds_every_name_within_its_edits(spark):
    rng = random.Random(11)
    firsts = ["abigail", "lea", "wei", "jo"]
    short = ["".join(rng.choices("aeiouklmnrst", k=k)) for k in (2, 2, 3, 3, 4, 4, 5, 5) for _ in range(6)]
    long = ["".join(rng.choices("aeiouklmnrst", k=k)) for k in (7, 8, 9, 10, 12) for _ in range(20)]
    known = sorted({f"P|{s}|{rng.choice(firsts)}" for s in short + long} | {f"C|{s}|" for s in long[::3]})
    asked = set()
    for q in known:
        kind, s, g = q.split("|")
        for _ in range(3):
            w = _edited(rng, s, False)
            if len(w) >= 2:
                asked.add(f"{kind}|{w}|{g}")
            if len(s) >= 9 or kind == "P" and len(s) >= 8:
                asked.add(f"{kind}|{_edited(rng, s, True)}|{g}")
    want = set()
    for q in asked:
        kind, s, g = q.split("|")
        limit = 2 if len(s) >= 7 else 1
        want |= {(q, k) for k in known if k[0] == kind and k.split("|")[2] == g and N.within(s, k.split("|")[1], limit)}
    df = lambda x: spark.createDataFrame([(q,) for q in sorted(x)], "q string")
    for cut in ({}, {"trie_names": 3, "asked_names": 4}):
        got = {(r.q, r.hit) for r in N.trie_join(df(known), df(asked), **cut).collect()}
        same_first = {(q, k) for q, k in got if q.split("|")[2] == k.split("|")[2]}
        assert len(want - same_first) <= 0.01 * len(want), sorted(want - same_first)[:5]
        assert same_first <= want


def test_short_surnames_and_orders(spark):
    none = (None, None, None, None)
    habits = N.Habits(ROWS + [("Abigail Kim", "abigail.kim@corp.example"), ("Abigail Wood", "abigail.wood@corp.example"), ("Lea Kim", "lea.kim@corp.example"), ("Lea Stone", "lea.stone@corp.example")] * 3)
    rows = [
        (1, "Abigail Kim", "abigail.kim@corp.example", *none),
        (2, "Kim, Abigail", None, *none),
        (3, "Abigail Wood", "abigail.wood@corp.example", *none),
        (4, "Abigail Wodo", None, *none),
        (5, "Lea Kim", "lea.kim@corp.example", *none),
        (6, "KIM LEA", "none", *none),
        (7, "Abigail Kim", "akim@home.example", *none),
        (8, "Sales Zentrix GmbH", "info@zentrix.example", *none),
        (9, "Zentrix GmbH", None, *none),
    ]
    df = spark.createDataFrame(rows, "rec_id long, name string, email string, title string, team string, org string, manager string")
    out = {}
    for r in N.link_names(df, habits).collect():
        out.setdefault(r.group_id, set()).add(r.rec_id)
    assert sorted(map(sorted, out.values())) == [[1, 2, 7], [3, 4], [5, 6], [8, 9]]


def test_first_names_by_shortened_words():
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choices("abcdikmnor", k=rng.randrange(3, 9)))
        k = 1 if len(w) < 6 else 2
        want = {w} if w in HABITS.given else set(HABITS.nick.get(w, ())) or {g for g in HABITS.given if N.within(w, g, k)}
        assert HABITS.givens(w) == want


def test_habits_are_counted_over_all_rows(spark):
    first = ["abigail", "augustin", "cornelia", "dmitri", "ekaterina", "guillermo", "henrietta", "ignacio", "josephine", "leonardo"]
    rare = [(f"{g} {s}", f"{g}.{s}@corp.example") for g in first for s in ("falmalescu", "berquaham")]
    # Cut in two when typed, the name of a company looks like a first name, as often as it stands there.
    rare += [("Kestle Wick", f"{w}.kestlewick@kestlewick.example") for w in ("team", "contact", "info")] + [("Kestle Wick Ferker", "team.kestlewick@hosting.example")] * 3
    rare += [("Kestlewick Ferker", "kestlewick.team@hosting.example"), ("Nelly Torvezley" + " (temp)" * 30, "cornelia.torvezley@corp.example"), ("Nelly Falmalescu", "cornelia.falmalescu@corp.example")]
    many = [("Anna Falmalescu", "anna.falmalescu@corp.example"), ("Anna Torvezley", "anna.torvezley@corp.example")]
    df = spark.createDataFrame(rare, "name string, email string").unionByName(spark.createDataFrame(many * 30_000, "name string, email string"))
    df = df.selectExpr("monotonically_increasing_id() AS rec_id", "name", "email")
    got, want = N.fit_habits(df), N.Habits(rare + many * 30)
    assert got.given == want.given == {*first, "anna"}
    assert got.nick == want.nick == {"nelly": {"cornelia"}}
    assert got.givens("nelly") == {"cornelia"} and N.fit_habits(df.limit(0)).given == set()
