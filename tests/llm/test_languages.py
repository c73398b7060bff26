import pytest

from knowgrid.llm import languages as G

EN = ["The ledger service still drops old tokens after midnight.", "Please review the draft because the export was slow.", "Who knows why the queue keeps growing in the western region?"]
DE = ["Der Dienst verliert nach Mitternacht noch immer alte Schlüssel.", "Bitte schaut euch den Entwurf an, denn der Export war langsam.", "Weiß jemand, warum die Warteschlange in der Region wächst?"]
RU = ["Служба всё ещё теряет старые ключи после полуночи.", "Кто-нибудь знает, почему очередь растёт в западном регионе?"]
LABELLED = [("en", " ".join(EN))] * 6 + [("de", " ".join(DE))] * 6 + [("ru", " ".join(RU))] * 6 + [("de", EN[0])]


@pytest.fixture(scope="module")
def model():
    return G.fit(LABELLED)


def codes(model, text):
    return [c for c, _, _ in model.stretches(text)]


def test_stretches(model):
    assert codes(model, EN[0]) == ["en"] and codes(model, DE[1]) == ["de"] and codes(model, RU[0]) == ["ru"]
    assert codes(model, EN[0] + "\n" + DE[0] + " " + DE[2] + "\n\n" + EN[1]) == ["en", "de", "en"]
    assert codes(model, "select count(*) from t where k > 5;\n" + DE[0] + "\nERR 12ab 1.2.3.4:5 rc=7 https://x.example/the/of") == ["de"]
    assert all(0 <= p <= 1 for _, p, _ in model.stretches(EN[0] + DE[0]))
    assert codes(model, "`kubectl rollout undo`\nhttps://wiki.example/x") == [] and codes(model, None) == [] and codes(model, " ") == []


def test_unseen_words_back_off_to_ngrams(model):
    assert codes(model, "Schlüsselregionen verlierenden Mitternachtsdienste") == ["de"]


def test_change_inside_a_sentence(model):
    glued = EN[0][:-1] + " and " + EN[1][:-1] + " " + DE[0][:-1].lower() + " " + DE[1].lower()
    assert codes(model, glued) == ["en", "de"]


def test_change_inside_a_sentence_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = G.fit(G.sample_labelled(docs, "doc_id", "text", "lang"))
    text = "we looked at the report of the team again and it was not clear who should have read it before the end of the week und dann haben wir das noch nicht mit der"
    assert codes(m, text) == ["en", "de"]


def test_paths_are_those_of_viterbi():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    sizes = [5, 1, 0, 4, 5]
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores, stops = -rng.random((at[-1], 3)) * 12, rng.random(at[-1]) < 0.4
    got = G.best_paths(scores, stops, at)
    cost = lambda path, a: sum(scores[a + i, p] for i, p in enumerate(path)) - sum(
        (G.SWITCH_SENTENCE if stops[a + i] else G.SWITCH_WORD) for i in range(1, len(path)) if path[i] != path[i - 1]
    )
    for a, b in zip(at[:-1], at[1:]):
        if b > a:
            best = max(cost(p, a) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(cost(got[a:b].tolist(), a) - best) < 1e-9


def test_batches_don_t_change_results(model):
    texts = [EN[0] * 30, None, "", DE[1], RU[0] + "\n" + EN[2], "ok", EN[1] + " " + DE[0] + " " + DE[2]]
    assert model.label(texts) == [model.stretches(t) for t in texts]


@pytest.mark.parametrize(("label", "want"), [("en-US", "en"), ("English", "en"), ("DEU", "de"), ("it", ""), (None, None), ("??", None), ("unknown", None), ("zxx", None)])
def test_labels(label, want):
    assert G.label_code(label) == want


def test_held_out_accuracy_and_states(spark, model):
    rows = [(1, EN[2], "en", 0), (2, DE[2], "en", 0), (3, RU[1], None, 0), (4, None, "en", 0), (5, "", "en", 0), (6, EN[0] * 4000, "eng", 0), (6, EN[0] * 4000, "eng", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    got = {(r.doc_id, r.lang_code, r.label_state) for r in G.label_stretches(df, model=model).collect()}
    assert got == {(1, "en", "right"), (2, "de", "wrong"), (3, "ru", "missing"), (6, "en", "right")}
    assert G.label_stretches(df.limit(0)).count() == 0


def test_held_out_accuracy_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = G.fit(G.sample_labelled(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang"))
    held = docs.where("doc_id % 2 = 1 and lang in ('en', 'de', 'fr', 'es')").collect()
    right = [m.stretches(r.text)[0][0] == r.lang for r in held if len(m.stretches(r.text)) == 1]
    assert sum(right) >= 0.9 * len(right)
