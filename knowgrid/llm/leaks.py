"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search, then alignment of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowgrid.llm.prose import plain_words
from knowgrid.session import spread

#: Words of an item in a row that make a leak.
LEAK_WORDS = 14
#: Words of a seed. A run of LEAK_WORDS with three scattered edits keeps at least one run of three words whole.
SEED_WORDS = 3
#: Letters by which a search window is compared, and letters of a block of it.
WINDOW, BLOCK = 12, 4
#: Words by which an edited passage may drift from the place where the item has them.
BAND = 6
#: Seeds that a passage of LEAK_WORDS keeps in a row of places, with three scattered edits.
LEAST_SEEDS = 3
#: Share of a span's weight that the document must have.
LEAST_MET = 0.7
#: Characters of items that one search holds in memory; a larger set is searched in several passes.
MAX_ITEM_CHARS = 20_000_000


class WuManber:
    """Multi-pattern search over one string: shift table by block, buckets by window, direct comparison."""

    def __init__(self, patterns: dict[str, list], window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        self.default = window - block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, list[str]]] = {}
        self.patterns = patterns
        for p in patterns:
            head = p[:window]
            for end in range(block, window + 1):
                key, jump = head[end - block : end], window - end
                if jump < self.shift.get(key, self.default):
                    self.shift[key] = jump
            self.bucket.setdefault(head[-block:], {}).setdefault(head, []).append(p)

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, pattern) of every occurrence."""
        w, b, n = self.window, self.block, len(text)
        shift, default, bucket = self.shift.get, self.default, self.bucket
        end = w
        while end <= n:
            jump = shift(text[end - b : end], default)
            if jump:
                end += jump
                continue
            same = bucket[text[end - b : end]].get(text[end - w : end])
            if same:
                for p in same:
                    if text.startswith(p, end - w):
                        yield end - w, p
            end += 1


def seeds_of(words: list[str], seed_words: int = SEED_WORDS, least: int = WINDOW) -> list[tuple[str, int]]:
    """Runs of ``seed_words`` words as text between blanks, lengthened to the search window, and the place of each.

    The last runs, with nothing to lengthen them by, begin earlier instead.
    """
    out = []
    for k in range(len(words) - seed_words + 1):
        n, at = seed_words, k
        run = " " + " ".join(words[at : at + n]) + " "
        while len(run) < least and (at + n < len(words) or at > 0):
            at, n = (at, n + 1) if at + n < len(words) else (at - 1, n + 1)
            run = " " + " ".join(words[at : at + n]) + " "
        if len(run) >= least:
            out.append((run, at))
    return out


def _close(a: str, b: str) -> bool:
    """Whether two words differ by a slip only: one letter more, less, changed or swapped, in a word of four or more."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def aligned_run(item: list[str], doc: list[str], shift: int, weight: list[float] | None = None, band: int = BAND) -> tuple[int, float]:
    """Words of the item that the best local alignment with ``doc`` spans, and the share of their weight that is met.

    Word k of the item is compared with the words of ``doc`` around ``k + shift``, up to ``band`` away. A met word
    (or one but for a slip) counts 1, any edit -1, and three edits in a row end the run: single edits are
    bridged, a change of subject isn't.
    """
    width = 2 * band + 1
    weight = weight or [1.0] * len(item)
    dead = (0, 0, 0.0, 0)  # score, first word of the item, weight met, edits in a row
    row, best, at = [dead] * (width + 1), 0, (0, 0, 0.0)
    for i, w in enumerate(item):
        new, left = [], dead
        for k in range(width):
            j = i + shift - band + k
            diag, up = row[k], row[k + 1]
            if 0 <= j < len(doc) and (w == doc[j] or _close(w, doc[j])):
                cell = (diag[0] + 1, diag[1], diag[2] + weight[i], 0) if diag[0] > 0 else (1, i, weight[i], 0)
            else:
                cell = max(diag, up, left)
                cell = (cell[0] - 1, cell[1], cell[2], cell[3] + 1) if cell[0] > 1 and cell[3] < 2 else dead
            new.append(cell)
            left = cell
            if cell[0] > best:
                best, at = cell[0], (cell[1], i + 1, cell[2])
        row = [*new, dead]
    return at[1] - at[0], at[2] / (sum(weight[at[0] : at[1]]) or 1.0)


class LeakFinder:
    """The seeds of a set of items in one search structure."""

    def __init__(self, items: list[tuple[int, str]], leak_words: int = LEAK_WORDS, slack: int = 2):
        self.words = {i: plain_words(t) for i, t in items if t}
        self.words = {i: w for i, w in self.words.items() if len(w) >= leak_words}
        self.leak_words, self.slack = leak_words, slack
        # Words that many items share say little about which of them a passage is from.
        df = Counter(x for w in self.words.values() for x in set(w))
        self.weight = {i: [math.log((1 + len(self.words)) / df[x]) + 0.05 for x in w] for i, w in self.words.items()}
        where: dict[str, list[tuple[int, int]]] = {}
        for i, w in self.words.items():
            for run, at in seeds_of(w):
                where.setdefault(run, []).append((i, at))
        self.search = WuManber(where)

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """(item, span, share met) of the items that a text shares at least one seed with."""
        if not text or not self.words:
            return []
        words = plain_words(text)
        if len(words) < SEED_WORDS:
            return []
        joined = " " + " ".join(words) + " "
        hits: dict[int, list[tuple[int, int]]] = {}
        place = seen = 0
        for at, p in self.search.find(joined):  # in order of place
            place, seen = place + joined.count(" ", seen, at), at
            for i, k in self.search.patterns[p]:
                hits.setdefault(i, []).append((place - k, k))
        out = []
        for i, places in hits.items():
            if len(places) < LEAST_SEEDS:
                continue
            item, best, group = self.words[i], (0, 0.0), []
            for shift, k in [*sorted(places), (None, 0)]:
                if group and (shift is None or shift - group[0][0] > BAND):
                    # Passages of one item may lie far apart in a document; each has a shift of its own.
                    if len({x for _, x in group}) >= LEAST_SEEDS:
                        # A longer run that is too weak must not hide one that counts.
                        best = max(best, aligned_run(item, words, group[len(group) // 2][0], self.weight[i]), key=lambda r: (self.counts(*r), r))
                    group = [] if shift is None else [x for x in group if shift - x[0] <= BAND]
                group.append((shift, k))
            if best[0]:
                out.append((i, *best))
        return out

    def counts(self, span: int, met: float) -> bool:
        return span >= self.leak_words - self.slack and met >= LEAST_MET

    def leaks(self, text: str | None) -> list[tuple[int, int, float]]:
        """The items leaked: a span of ``leak_words`` (less ``slack``, for edits at its ends) with most of its weight met."""
        return [x for x in self.spans(text) if self.counts(*x[1:])]


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """``item_id, doc_id, span, met`` of every document that holds a passage of an item.

    Documents are scanned once, whole, where they lie: no shuffle. The items go to every task, so their size is
    checked; a larger set is split by key and takes one scan for each part. NULL and blank texts hold nothing,
    items of fewer words than a leak can't leak, repeated documents and items are reported each by its key.
    """
    total = items.select(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    passes = max(1, -(-total // max_item_chars))
    schema = pa.schema([(item_key, pa.int64()), (doc_key, pa.int64()), ("span", pa.int32()), ("met", pa.float64())])
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64(item_key), F.lit(passes)) == k).select(item_key, text).orderBy(item_key).collect()
        known = [(r[0], r[1]) for r in part]

        def run(batches: Iterator[pa.RecordBatch], known: list = known) -> Iterator[pa.RecordBatch]:
            finder = LeakFinder(known)
            for b in batches:
                rows = [(i, d, s, m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, s, m in finder.leaks(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        found = spread(docs.select(F.col(doc_key).cast("long"), F.col(text)).where(F.col(text).isNotNull())).mapInArrow(run, f"`{item_key}` long, `{doc_key}` long, span int, met double")
        out = found if out is None else out.unionByName(found)
    return out
