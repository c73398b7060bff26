import random

from hypothesis import given, settings
from hypothesis import strategies as st

from knowgrid.llm import leaks as L

ITEM = "Quaraquth lost 5370 silent anchors once Thradezeenis moved the lane and only Thradezeenis may touch muted kettles above mark 1407 before Quaraquth counted its wharf"
OTHER = "Vrelovornis sold 2211 paper seats until Umbnutyx closed the mill and nobody at Umbnutyx saw why the crates outlived Vrelovornis by 77 days since the loft was sealed"
FILL = "we measured cases during the weekly deploy and the audit log still retries old tokens "


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=7), min_size=1, max_size=8, unique=True), st.text("ab", max_size=60))
def test_search_finds_every_occurrence(patterns, text):
    got = sorted(L.WuManber({p: [] for p in patterns}, 4, 2).find(text))
    assert got == sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


def found(text):
    return {i for i, _, _ in L.LeakFinder([(1, ITEM), (2, OTHER)]).leaks(text)}


def test_leaks_through_typography_and_edits():
    w = ITEM.split()
    assert found(FILL + " ".join(w[3:19]) + FILL) == {1}
    assert found(FILL + " ".join(w[3:19]).upper()) == {1}
    assert found("> " + " ".join(w[:9]) + "\n> " + " ".join(w[9:18])) == {1}
    assert found("**Quaraquth** lost <b>5370</b> si-\nlent anchors, once &quot;Thradezeenis&quot; moved the lane — and only **Thradezeenis** may touch") == {1}
    edited = w[3:21]
    edited[4], edited[9] = "also", "Thradezeenis the"
    del edited[13]
    assert found(FILL + " ".join(edited)) == {1}
    assert found(" ".join(w) + FILL + OTHER) == {1, 2}


def test_a_longer_weak_run_hides_no_leak():
    w = ITEM.split()
    weak = ["zzz" if i in (5, 7, 10, 12, 13, 17, 19, 22) else x for i, x in enumerate(w)]
    assert found(" ".join(weak)) == set()
    assert found(" ".join(weak) + " " + FILL * 4 + " ".join(w[2:17])) == {1}


def test_short_echoes_and_strangers_do_not_count():
    w = ITEM.split()
    assert found(FILL + " ".join(w[3:10]) + " ...") == set()
    assert found(" ".join(w[:6]) + FILL * 3 + " ".join(w[12:18])) == set()
    assert found(FILL * 50) == set() and found("") == set() and found(None) == set()


def test_tables_and_passes(spark):
    docs = spark.createDataFrame([(1, FILL + ITEM, "x"), (1, FILL + ITEM, "x"), (2, None, "x"), (3, " ", "x"), (4, FILL * 3000 + OTHER, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, ITEM), (4, None), (5, "too short")], "item_id long, text string")
    for limit in (10, 10**6):
        got = sorted((r.item_id, r.doc_id) for r in L.find_leaks(docs, items, max_item_chars=limit).collect())
        assert got == [(1, 1), (1, 1), (2, 4), (3, 1), (3, 1)]
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0


def test_against_plain_windows_on_random_texts():
    rng = random.Random(1)
    words = [f"w{i}x{rng.randrange(10**6)}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(20)]
    finder = L.LeakFinder(items)
    for _ in range(60):
        i, n = rng.randrange(20), rng.choice([5, 8, 14, 20])
        at = rng.randrange(40 - n)
        doc = rng.choices(words, k=30) + items[i][1].split()[at : at + n] + rng.choices(words, k=30)
        got = {x for x, _, _ in finder.leaks(" ".join(doc))}
        assert got == ({i} if n >= 14 else set())
