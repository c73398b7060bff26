"""Missing or wrong language labels: known words first, character n-grams for unseen ones, stretches by Viterbi."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowgrid.llm.prose import unmarked
from knowgrid.session import hash_sample, spread

# The languages told apart, with the codes and names that labels use for them.
NAMES = {
    "en": "en eng english anglais englisch inglés inglês engels английский",
    "de": "de deu ger german deutsch allemand alemán alemão duits немецкий",
    "fr": "fr fra fre french français francais französisch francés francês frans французский",
    "es": "es spa spanish español espanol castellano espagnol spanisch espanhol spaans испанский",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portugees португальский",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch holandés holandês flemish нидерландский",
    "ru": "ru rus russian русский russe russisch ruso russo russisch",
}
CODES = tuple(NAMES)
_OF = {w: code for code, ws in NAMES.items() for w in ws.split()}

#: Labelled documents that the model is fitted on, at most so many of each language, chosen by a hash of the key.
FIT_DOCS = 300
#: Characters of each such document used for fitting (labelling always reads whole texts).
FIT_CHARS = 3_000
#: Cost in nats of changing the language between two words, and between two sentences.
SWITCH_WORD, SWITCH_SENTENCE = 14.0, 5.0
#: Most that one word may speak against a language.
CLIP = 4.0
#: Words times texts that go through Viterbi together, at most, unless one text alone has more.
PATH_CELLS = 100_000
#: Distinct words whose scores are kept from one batch of texts to the next.
CACHE_WORDS = 200_000
#: Words of prose that a document, and a stretch, needs.
LEAST_WORDS = 3

_URL = re.compile(r"(?:https?://|www\.)\S+|(?<!\S)\S+@\S+\.\S+")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_SQL = re.compile(r"\b(?:select|insert\s+into|update|delete\s+from|create\s+table)\b[^;\n]*;", re.I)
_LOG = re.compile(r"\b(?:ERR|WARN|INFO|DEBUG|ERROR|TRACE|FATAL)\b[^\n]*?(?:\brc=\S+|(?=\n)|\Z)|\bcommit\s+[0-9a-f]{7,}\b|\b0x[0-9a-f]+(?:\s+\d+)*", re.I)
_LOG_SIGNS = ("err", "warn", "info", "debug", "trace", "fatal", "commit", "0x")
_SENTENCE = re.compile(r"[.!?…][\"')\]»”]*\s+")
_OPENING = re.compile(r"(?<=[a-zà-ÿа-яё])\s+(?=[¿¡])")
#: Stands between two sentences.
_STOP = "\x00"
_NO_WORD = re.compile(r"[\d_=\\{}<>$@/⁰¹²³⁴-⁹₀-₉]")
_WORDS = re.compile(_STOP + r"|[^\W\d_]+(?:'[^\W\d_]+)*")


def label_code(label: str | None) -> str | None:
    """The language that a label stands for (code, region or name), '' for another one, None if it says nothing."""
    low = re.sub(r"[^\w]+", "-", (label or "").strip().lower()).strip("-").replace("_", "-")
    if not low or low in ("und", "unknown", "xx", "zxx", "mul", "mis", "none", "null", "n-a", "na"):
        return None
    return _OF.get(low) or _OF.get(low.split("-")[0]) or ""


def marked_words(text: str | None) -> list[str]:
    """Lower-case words of a text with a mark between sentences; code, logs, links, keys and numbers are left out."""
    if not text or not text.strip():
        return []
    text = unmarked(text.replace(_STOP, " "))
    text = _CODE.sub(" ", text) if "`" in text else text
    text = _URL.sub(" ", text) if "@" in text or "http" in text or "www." in text else text
    text = _SQL.sub("\n", text) if ";" in text else text
    low = text.lower()
    text = _LOG.sub("\n", text) if any(sign in low for sign in _LOG_SIGNS) else text
    text = _OPENING.sub(f" {_STOP} ", text) if "¿" in text or "¡" in text else text
    text = _SENTENCE.sub(f" {_STOP} ", text).replace("\n", f" {_STOP} ")
    if _NO_WORD.search(text):
        no_word = _NO_WORD.search
        text = " ".join([t for t in text.split() if not no_word(t)])
    return _WORDS.findall(text.lower().replace("’", "'"))


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    out: list[list[str]] = [[]]
    for w in marked_words(text):
        if w != _STOP:
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return [u for u in out if u]


def best_paths(scores: np.ndarray, stops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The language of every word by Viterbi, for many texts at once: text ``i`` has the rows ``at[i]`` to ``at[i + 1]``
    of ``scores`` (words by languages); ``stops`` marks words that begin a sentence.

    Texts of like length go through together, one step for a word of each, so no step is a loop over languages or texts.
    """
    path, sizes = np.zeros(len(scores), np.int8), np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin = 0
    while begin < len(order):
        longest = int(sizes[order[begin]])
        docs = order[begin : begin + max(1, PATH_CELLS // longest)]
        begin += len(docs)
        first, n = at[docs], sizes[docs]
        live = np.searchsorted(-n, -np.arange(longest), "left")  # texts are sorted, the longest first
        v = scores[first].copy()
        back = np.zeros((longest, len(docs), scores.shape[1]), np.int8)
        for t in range(1, longest):
            k = live[t]
            rows = first[:k] + t
            old = v[:k]
            top = old.argmax(1)
            jump = old[np.arange(k), top] - np.where(stops[rows], SWITCH_SENTENCE, SWITCH_WORD)
            stay = old >= jump[:, None]
            back[t, :k] = np.where(stay, np.arange(old.shape[1]), top[:, None])
            v[:k] = np.where(stay, old, jump[:, None]) + scores[rows]
        now = v.argmax(1)
        for t in range(longest - 1, -1, -1):
            k = live[t]
            path[first[:k] + t] = now[:k]
            now[:k] = back[t, np.arange(k), now[:k]]
    return path


class Model:
    """Log frequencies per language of words and of character n-grams."""

    def __init__(self, counts: dict[str, Counter], grams: int = 4, least: int = 2):
        self.codes = [c for c in CODES if counts.get(c)]
        vocabulary = Counter()
        for c in self.codes:
            vocabulary.update(counts[c])
        totals = {c: sum(counts[c].values()) or 1 for c in self.codes}
        size = len(vocabulary) or 1
        self.words = {
            w: self._relative([math.log((counts[c][w] + 0.01) / (totals[c] + 0.01 * size)) for c in self.codes]) for w, n in vocabulary.items() if n >= least
        }
        self.grams, self.top = {}, grams
        for n in range(1, grams + 1):
            per = {c: Counter() for c in self.codes}
            for c in self.codes:
                for w in counts[c]:
                    t = f" {w} "
                    per[c].update({t[k : k + n] for k in range(len(t) - n + 1)})
            whole = {c: sum(per[c].values()) or 1 for c in self.codes}
            seen = Counter()
            for c in self.codes:
                seen.update(per[c])
            self.grams.update({g: self._relative([math.log((per[c][g] + 0.5) / (whole[c] + 0.5 * len(seen))) for c in self.codes]) for g, k in seen.items() if k >= 2})
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.codes)))

    @staticmethod
    def _relative(x: list[float]) -> tuple[float, ...]:
        top = max(x)
        return tuple(max(v - top, -CLIP) for v in x)

    def score(self, w: str) -> tuple[float, ...]:
        """Of a word: its own frequencies if it is known, else those of its longest known n-grams, at half their weight."""
        got = self.words.get(w)
        if got is None:
            t, sums, n = f" {w} ", [0.0] * len(self.codes), 0
            for k in range(len(t)):
                for m in range(self.top, 0, -1):
                    g = self.grams.get(t[k : k + m]) if k + m <= len(t) else None
                    if g:
                        sums, n = [a + b for a, b in zip(sums, g)], n + 1
                        break
            got = tuple(0.5 * v for v in self._relative([s / max(1, n) for s in sums]))
        return got

    def _row(self, w: str) -> int:
        """Where the scores of a word stand in the table, which they are put into on first sight."""
        n = self.at[w] = len(self.at)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.score(w)
        return n

    def label(self, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
        """(language, confidence, words) of each maximal stretch in one language, for each text; none without prose."""
        if not self.codes:
            return [[] for _ in texts]
        if len(self.at) > CACHE_WORDS:
            self.at = {}
        ids, stops, at = [], [], [0]
        for text in texts:
            seen = self.at
            mine = [-1 if w == _STOP else seen[w] if w in seen else self._row(w) for w in marked_words(text)]
            a = np.array(mine, np.int64)
            words = a >= 0
            if words.sum() < LEAST_WORDS:
                a, words = a[:0], words[:0]
            begins = np.ones(len(a), bool)
            begins[1:] = ~words[:-1]
            ids.append(a[words])
            stops.append(begins[words])
            at.append(at[-1] + len(ids[-1]))
        at = np.array(at)
        scores = self.table[np.concatenate(ids)]
        path = best_paths(scores, np.concatenate(stops), at)
        return [self._stretches(path[a:b], scores[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _stretches(self, path: np.ndarray, scores: np.ndarray) -> list[tuple[str, float, int]]:
        """Stretches of one text's path. One of fewer than ``LEAST_WORDS`` words is no stretch, unless there is no other."""
        if not len(path):
            return []
        cut = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
        size = np.diff(np.append(cut, len(path)))
        sums = np.add.reduceat(scores, cut, axis=0)
        z = np.exp((sums - sums.max(1, keepdims=True)) / np.sqrt(size)[:, None])
        sure = (z[np.arange(len(cut)), path[cut]] / z.sum(1)).tolist()
        merged: list[list] = []
        for lang, conf, n in zip(path[cut].tolist(), sure, size.tolist()):
            if n < LEAST_WORDS and len(cut) > 1:
                continue
            if merged and merged[-1][0] == lang:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], conf), merged[-1][2] + n
            else:
                merged.append([lang, conf, n])
        return [(self.codes[a], round(b, 4), n) for a, b, n in merged]

    def stretches(self, text: str | None) -> list[tuple[str, float, int]]:
        """The stretches of one text."""
        return self.label([text])[0]


def fit(labelled: list[tuple[str, str]]) -> Model:
    """From (language, text). Labels may be wrong and texts mixed: sentences are labelled by a first model and counted again."""
    counts: dict[str, Counter] = defaultdict(Counter)
    parsed = [(code, sentences(text)) for code, text in labelled]
    for code, units in parsed:
        for u in units:
            counts[code].update(u)
    for _ in range(2):
        model, counts = Model(counts), defaultdict(Counter)
        for _, units in parsed:
            for u in units:
                sums = sorted(((sum(c), code) for c, code in zip(zip(*[model.score(w) for w in u]), model.codes)), reverse=True)
                if len(u) >= 4 and (len(sums) < 2 or sums[0][0] - sums[1][0] > 3):
                    counts[sums[0][1]].update(u)
    return Model(counts)


def sample_labelled(docs: DataFrame, key: str, text: str, lang: str, per_language: int = FIT_DOCS, chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` documents for each language, so the driver holds at most 7 * per_language * chars characters."""
    table = F.create_map(*[F.lit(x) for pair in _OF.items() for x in pair])
    low = F.lower(F.trim(F.col(lang)))
    base = F.regexp_extract(low, r"^([^-_\s]+)", 1)
    code = F.coalesce(F.when(low.isin(*_OF), table[low]), F.when(base.isin(*_OF), table[base]))
    named = docs.select(F.col(key).alias("_k"), F.substring(text, 1, chars).alias("_t"), code.alias("_c")).where("_c is not null and length(trim(_t)) >= 40")
    # A language of one document in a hundred still fills its part of a sample of this size.
    named = hash_sample(named, "_k", 100 * per_language)
    order = Window.partitionBy("_c").orderBy(F.xxhash64("_k"), "_k")
    rows = named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).orderBy("_c", "_n").collect()
    return [(r["_c"], r["_t"]) for r in rows]


def label_stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """``key, seg_no, lang_code, confidence, words, n_segs, label_state`` of every stretch of every document with prose.

    ``label_state`` is 'missing' (NULL, blank or meaningless), 'wrong' (it names a language other than that of most
    words) or 'right'. The model is fitted on a bounded sample (``FIT_DOCS`` a language); labelling reads all
    documents, whole, in one pass without a shuffle. NULL, blank and prose-free texts give no row; repeated
    documents are labelled each by its key.
    """
    model = model or fit(sample_labelled(docs, key, text, lang))
    schema = pa.schema(
        [(key, pa.int64()), ("seg_no", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("n_segs", pa.int32()), ("label_state", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            docs, texts, labels = (b.column(i).to_pylist() for i in range(3))
            for d, segs, label in zip(docs, model.label(texts), labels):
                if segs:
                    words = Counter()
                    for code, _, n in segs:
                        words[code] += n
                    said = label_code(label)
                    state = "missing" if said is None else "right" if said == words.most_common(1)[0][0] else "wrong"
                    rows += [(d, n, code, conf, w, len(segs), state) for n, (code, conf, w) in enumerate(segs, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kept = docs.select(F.col(key).cast("long"), F.col(text), F.col(lang)).where(F.length(F.trim(F.col(text))) > 0)
    return spread(kept).mapInArrow(run, f"`{key}` long, seg_no int, lang_code string, confidence double, words int, n_segs int, label_state string")
