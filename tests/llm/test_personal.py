import pytest

from knowgrid.llm import personal as P

NAMES = [f"{g} {s}{e}" for g in ("Ann", "Noor", "Iris", "Victor", "Otto") for s in ("Fal", "Ber", "Tor", "Lun") for e in ("malescu", "quaham", "dinberg")]
LEX = P.Lexicon(NAMES, ["the cache and the queue run on a gateway near the witness stand", "thanks, the cache queue gateway witness works per user"] * 3)
CASES = [
    ("Report came via noor.falmalescu@korbeck.example, attached.", [("EMAIL", "noor.falmalescu@korbeck.example")]),
    ("Pin owner@HEAD~12, ask @channel.", []),
    ("Call 415-555-0163 ext. 12 if it reopens.", [("PHONE", "415-555-0163 ext. 12")]),
    ("SMS to +33 1 99 00 79 15 failed; 030/23125604 rang", [("PHONE", "+33 1 99 00 79 15"), ("PHONE", "030/23125604")]),
    ("offset 6145665012, order 4623-5400-91, host 192.0.2.66, build 4.27.19", []),
    ("Ssn=967-41-2123. KYC ref shows 92.02.24-908.98.", [("ID_NUMBER", "967-41-2123"), ("ID_NUMBER", "92.02.24-908.98")]),
    ("NI no. QQ 31 99 26 C on file", [("ID_NUMBER", "QQ 31 99 26 C")]),
    ("Lives at 906 Gorse Hill Street, Flat 7C, 76061 Port Halden according to the form.", [("STREET_ADDRESS", "906 Gorse Hill Street, Flat 7C, 76061 Port Halden")]),
    ("Premises: Hohle Str. 124, 84241 Dunmarsh; 9, rue des Tarnelles refused", [("STREET_ADDRESS", "Hohle Str. 124, 84241 Dunmarsh"), ("STREET_ADDRESS", "9, rue des Tarnelles")]),
    ("8139 Kiln nodes rebooted. Moved 1107 Pennyroyal workers. Suite 20 of the pack.", []),
    ("Witness Noor Falmalescu and Ann B. Bermalescu spoke to A. Torquaham.", [("NAME", "Noor Falmalescu"), ("NAME", "Ann B. Bermalescu"), ("NAME", "A. Torquaham")]),
    ("Dr. Lundinberg, Iris's laptop; per ANN FALQUAHAM; mr. otto torquaham", [("NAME", "Lundinberg, Iris"), ("NAME", "ANN FALQUAHAM"), ("NAME", "otto torquaham")]),
    ("Thanks Iris Cache, Victor Queue and Harrow Gateway", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_pieces(text, want):
    assert [(k, text[a:b]) for a, b, k in P.find_spans(text, LEX)] == want


def test_redaction_keeps_the_rest():
    text = "Ask Noor Falmalescu (noor@a.example) soon."
    assert P.redact(text, P.find_spans(text, LEX)) == "Ask [NAME] ([EMAIL]) soon."


def test_check_digits():
    assert P._luhn("4539578763621486") and not P._luhn("4539578763621487")
    assert P._mod97("GB82 WEST 1234 5698 7654 32") and not P._mod97("GB82 WEST 1234 5698 7654 33")
    assert P._cpf("52998224725") and not P._cpf("52998224726")


def test_tables(spark):
    rows = [(1, CASES[0][0]), (1, CASES[0][0]), (2, None), (3, ""), (4, "word " * 60_000 + CASES[0][0] + CASES[0][0])]
    df = spark.createDataFrame(rows, "row_id long, text string")
    t = P.union_texts([("notes", df, "text")])
    got = sorted(tuple(r) for r in P.personal_pieces(t, LEX).collect())
    assert got == [("notes", i, "EMAIL", "noor.falmalescu@korbeck.example") for i in (1, 1, 4)]
    red = {r.row_id: r.redacted for r in P.personal_pieces(t, LEX, redacted=True).collect()}
    assert red[1] == "Report came via [EMAIL], attached." and red[2] is None and red[3] == ""
    lex = P.fit_lexicon(df.limit(0).select("row_id", "text"), df.limit(0).select("row_id", "text"))
    assert P.personal_pieces(t.limit(0), lex).count() == 0 and P.find_spans(CASES[0][0], lex)


def test_lexicon_counts_all_names_and_whole_texts(spark):
    rare = ["harness", "ledger", "turbine", "walnut", "pebble", "lantern", "copper", "meadow", "thicket", "saddle"]
    texts = [f"the {w} is worn" for w in rare] * 2 + ["so " * 900 + "a kettle and a kettle", None, ""] + ["Orla Fitzgrau was there", "asked orla fitzgrau"] * 3 + ["Orla Fitzgrau left"] * 40
    first = ["Abigail", "Augustin", "Cornelia", "Dmitri", "Ekaterina", "Guillermo", "Henrietta", "Ignacio", "Josephine", "Leonardo"]
    names = [f"{g} Falmalescu" for g in first] * 2 + ["Mary Ann"] * 3 + ["Mary Ann Falmalescu"] * 9 + ["Cornelia Zyx", "Dmitri Zyx", None, ""]
    fill = ["Iris Bermalescu", "Iris Tormalescu", "Otto Lunmalescu"] * 10_000
    df = lambda x: spark.createDataFrame([(v,) for v in x], "v string").selectExpr("monotonically_increasing_id() AS k", "v")
    lex, want = P.fit_lexicon(df(names + fill), df(texts + ["it works"] * 20_000)), P.Lexicon(names + fill, texts + ["it works"] * 20_000)
    assert (lex.given, lex.surnames, lex.common, lex.ends) == (want.given, want.surnames, want.common, want.ends)
    assert {g.lower() for g in first} | {"mary", "iris", "otto"} == lex.given
    assert {*rare, "kettle", "works"} <= lex.common and "zyx" in lex.surnames
    # Written small now and then, but mostly as a name; and the second half of a first name is no surname.
    assert not {"orla", "fitzgrau"} & lex.common and "ann" not in lex.surnames
    found = lambda text: [text[a:b] for a, b, _ in P.find_spans(text, lex)]
    assert found("Harness Falmalescu left; Mary Ann Falmalescu stayed, so did Orla Falmalescu") == ["Mary Ann Falmalescu", "Orla Falmalescu"]
