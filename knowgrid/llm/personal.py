"""Personal information in free text: patterns propose, check digits confirm, context decides."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowgrid.session import discard, materialise, spread

EMAIL, PHONE, ID_NUMBER, STREET_ADDRESS, NAME = KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS", "NAME")
#: Names, and texts, of which a word needs one to be taken at its word; a rarer one has to be told from slips and ordinary words.
USUAL_NAMES, USUAL_TEXTS = 10_000, 3_000
#: Times written small for each time with a capital, from which a rarer word is an ordinary one.
SMALL_SHARE = 0.2
#: A span counts if pattern, check digits and context together reach this score.
THRESHOLD = 1.0

_EMAIL = re.compile(r"[A-Za-z0-9](?:[\w.%+-]*[\w%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")

_EXT = r"(?:,? ?(?:ext\.?|extension|x) ?\d{1,5}(?!\w))?"
_PHONE = re.compile(
    r"(?<![\w.@#/:~+-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\)|[ .-]?\d{1,5}){1,6}"
    r"|\(0?\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\(0\d{2,4}\) ?\d{5,7}"
    r"|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}"
    r"|1[2-9]\d{2}[2-9]\d{6}"
    r"|0\d([ .])\d{2}\2\d{2}\2\d{2}\2\d{2}"
    r"|0\d{2,4}/\d{5,9}|0\d{2,3} \d{3,4} \d{3,4}|0\d{4} \d{5,6}"
    r")" + _EXT + r"(?![\w@]|[-/]\d|\.\d)"
)
_PHONE_CUE = re.compile(r"\b(?:tel|phone|mobile|call|caller|callback|dial|sms|voicemail|hotline|paged|fax|rang)\b", re.I)
_NOT_PHONE = re.compile(r"(?:offset|job|order|trace|commit|port|batch|ticket|exhibits?|docket|build|host|queue|shard|rows|id)\W*$", re.I)

_ID = re.compile(
    r"(?<![\w.@#/:~+-])(?:"
    r"(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<ssn>\d{3}([- ])\d{2}\3\d{4})"
    r"|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d{2})"
    r"|(?P<nrn>\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2})"
    r"|(?P<dni>\d{8}-?[A-Z])"
    r"|(?P<fin>[A-Z]\d{7}[A-Z])"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<card>\d{4}([ -]?)\d{4}\10\d{4}\10\d{1,7})"
    r")(?![\w@]|[-/]\d|\.\d)"
)
_ID_CUE = re.compile(r"\b(?:ssn|social|national|identity|citizen|passport|licen[cs]e|tax|ni no|nino|kyc|id doc|applicant|form|account|iban|card)\b", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆĈČĎĐĒĘĚĞĢĪİĶĹĽŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽ]"
_WORD = _CAP + r"[\w'’]*(?:-" + _CAP + r"[\w'’]*)*"
_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Close|Terrace|Ter|Way|Boulevard|Blvd|Place|Pl|Square|Sq|Crescent|Cres|Row|Walk|Gardens|Grove|Hill|Parkway|Pkwy|Alley|Mews)"
_UNIT = r"(?:,? (?:Apt|Apartment|Unit|Flat|Suite|Ste|Floor|Room|Rm|Whg|Wohnung|App|Bât)\.? ?#?\w{1,6}|,? ?#\w{1,6})?"
_TOWN = r"(?:, (?:[A-Z]{0,2}-?\d{4,6} )?" + _WORD + r"(?: " + _WORD + r")?(?: \d{4,6})?)?"
_ADDRESS = re.compile(
    r"(?<![\w.@#/:~+-])(?:"
    r"(?P<en>\d{1,5}[A-Za-z]?(?:[-/]\d{1,4})? (?:(?:St\.|Mt\.) )?(?:(?:" + _WORD + r"|\d{1,3}(?:st|nd|rd|th)) ){1,4}" + _TYPE + r"(?![\w'’-]))(?P<dot>\.?)(?P<rest>" + _UNIT + _TOWN + r")"
    r"|(?P<de>(?:(?:Am|An der|An dem|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der) " + _WORD + r"|(?:" + _WORD + r" ){0,2}(?:Str\.|Straße|Strasse|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer)"
    r"|" + _CAP + r"\w*(?:straße|strasse|gasse|allee|weg|platz|ring|damm|ufer|str\.)) \d{1,5} ?[a-zA-Z]?(?!\w))(?P<derest>" + _UNIT + _TOWN + r")"
    r"|(?P<fr>\d{1,5}[A-Za-z]?(?: bis| ter)?,? (?:rue|avenue|allée|impasse|bd|boulevard|place|chemin|quai|cours|route|square|passage)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?" + _WORD + r"(?: " + _WORD + r")*)(?P<frrest>" + _UNIT + _TOWN + r")"
    r")"
)

_INITIAL = _CAP + r"\."
_NAME_RUN = re.compile(r"(?<![\w@./#:-])" + _CAP + r"(?:\.(?= )|[\w'’-]*)(?:(?: |, ?|\.(?=" + _CAP + r"[a-z]))(?:" + _CAP + r"(?:\.(?= )|[\w'’-]*)))*")
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "sir", "herr", "frau", "mme", "m"}


def _luhn(d: str) -> bool:
    s = [int(x) for x in reversed(d)]
    return sum(s[::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _cpf(d: str) -> bool:
    n = [int(x) for x in d]
    return all(sum(a * b for a, b in zip(n, range(k + 1, 1, -1))) * 10 % 11 % 10 == n[k] for k in (9, 10))


def id_score(kind: str, text: str, before: str, after: str) -> float:
    """1 for a well-formed number; check digits that fail cost as much, a word beside it gives it back."""
    digits = re.sub(r"\D", "", text)
    score = 1.0
    if kind == "cpf":
        score = 1.0 if _cpf(digits) else 0.3
    elif kind == "nrn":
        score = 1.0 if any(97 - int(p + digits[:9]) % 97 == int(digits[9:]) for p in ("", "2")) else 0.3
    elif kind == "dni":
        score = 1.0 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == text[-1] else 0.3
    elif kind == "fin":
        score = 0.6
    elif kind == "iban":
        score = 1.5 if _mod97(text) else 0.0
    elif kind == "card":
        score = 1.0 if 13 <= len(digits) <= 19 and _luhn(digits) else 0.0
    elif kind == "ssn":
        score = 0.6 if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" else 0.9
    if _NOT_PHONE.search(before) and not _ID_CUE.search(before[-30:]):
        score -= 0.6
    return score + (0.7 if _ID_CUE.search(before[-40:]) or _ID_CUE.search(after[:30]) else 0.0)


def phone_score(text: str, before: str) -> float:
    digits = re.sub(r"\D", "", re.split(r"ext|x", text)[0])
    if not 7 <= len(digits) <= 15:
        return 0.0
    score = 1.0 if re.search(r"[+() ./-]", text) else 0.8
    if _NOT_PHONE.search(before):
        score -= 0.7
    return score + (0.5 if _PHONE_CUE.search(before[-30:]) else 0.0) + (0.2 if len(digits) == 11 and digits[0] == "1" else 0.0)


def _plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower().replace("ł", "l").replace("ø", "o").replace("ı", "i").replace("ß", "ss")


def count_names(names: Iterable[str | None]) -> dict[str, list[int]]:
    """Of any part of the names: how often a word is the first and how often the last of two, and the middle one of three.
    The empty word has the number of names of two words."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for n in names:
        parts = (n or "").split()
        if len(parts) in (2, 3) and "," not in n and all(re.fullmatch(r"[^\W\d_][\w'’-]+", p) for p in parts):
            if len(parts) == 3:
                out[_plain(parts[1])][2] += 1
                continue
            out[""][0] += 1
            for k in (0, 1):
                out[_plain(parts[k])][k] += 1
    return out


def count_words(texts: Iterable[str | None]) -> dict[str, list[int]]:
    """Of any part of the texts: how often a word is written small and how often not. The empty word has their number."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    # Neither a word nor an address holds blanks: each piece between them is looked at once.
    pieces, words = Counter(), Counter()
    for t in texts:
        if t is not None:
            out[""][0] += 1
            pieces.update(t.split())
    for piece, k in pieces.items():
        for w in re.findall(r"(?<![\w@.])[^\W\d_]+(?![\w@]|\.\w)", _EMAIL.sub(" ", piece) if "@" in piece else piece):
            words[w] += k
    for w, k in words.items():
        out[_plain(w)][not w.islower()] += k
    return out


def usual_ends(ends: dict[str, int], surnames: int) -> set[str]:
    """Endings that are usual, of how many surnames of six letters or more have each."""
    return {e for e, k in ends.items() if k >= 3 and k >= 0.004 * surnames}


class Lexicon:
    """What first and last names look like here, and which words are ordinary ones."""

    def __init__(self, names: Iterable[str | None], texts: Iterable[str | None]):
        words = count_names(names)
        surnames = {w for w, (first, last, _) in words.items() if last > 2 * first}
        self.learn(words, count_words(texts), usual_ends(Counter(w[-3:] for w in surnames if len(w) >= 6), len(surnames)))

    def learn(self, words: dict[str, list[int]], seen: dict[str, list[int]], ends: set[str]) -> None:
        """From the counts of names and of texts, and the usual endings of surnames.

        Slips and chance repeat in a large table. A word that few names or texts have is an ordinary one if it is written small
        often enough beside how often it has a capital, and nearly always if it ends like a surname; only otherwise is it a name.
        """
        n_names, n_texts = words.get("", (0,))[0], seen.get("", (0,))[0]
        self.ends = ends

        def ordinary(w: str) -> bool:
            small, capital, _ = seen.get(w, (0, 0, 0))
            by_share = small * SMALL_SHARE > capital + 1 if len(w) >= 6 and w[-3:] in ends else small > capital * SMALL_SHARE
            return small >= 2 and (small * USUAL_TEXTS >= n_texts or by_share)

        def told(w: str, k: int) -> bool:
            return k >= 2 and (k * USUAL_NAMES >= n_names or not ordinary(w))

        words = {w: v for w, v in words.items() if w}
        self.given = {w for w, (first, last, _) in words.items() if first > 2 * last and told(w, first)}
        # A surname met only once may be a slip or a nickname: its ending has to be usual, too. Part of a double first name
        # comes last where the surname was left out, and stands in the middle more often.
        self.surnames = {w for w, (first, last, mid) in words.items() if last > 2 * first and (w[-3:] in ends or last > mid and told(w, last))}
        self.common = {w for w in seen if w and w not in self.given and w not in self.surnames and ordinary(w)}
        self.common |= {"cache", "queue", "gateway", "cluster", "pipeline", "platform", "systems", "holdings", "industries", "group", "corporation", "software", "team", "project"}

        tail = "|".join(sorted(self.ends))
        self.small = re.compile(rf"(?<![\w@./#:+-])[a-zß-öø-ÿąćęłńśźżğışčř][\w'’-]*(?:{tail})(?![\w@-]|\.\w)") if tail else None

    def is_given(self, w: str, strict: bool = False) -> bool:
        p = _plain(w)
        return p in self.given or (not strict and len(p) >= 2 and p not in self.common and p not in self.surnames and p not in _TITLES and w[0].isupper() and w.isalpha())

    def is_surname(self, w: str) -> bool:
        p = _plain(w.replace("’", "'"))
        p = p.split("'", 1)[1] if "'" in p[:3] else p
        if p in self.common or p in self.given:
            return False
        return p in self.surnames or (len(p) >= 6 and p[-3:] in self.ends) or ("-" in p and all(self.is_surname(x) for x in w.split("-") if x))


def _names(text: str, lex: Lexicon) -> Iterator[tuple[int, int]]:
    """Spans of person names in runs of capitalised words: a surname, with what goes with it on its left or right."""
    for run in _NAME_RUN.finditer(text):
        toks = [(m.group(), run.start() + m.start()) for m in re.finditer(_CAP + r"(?:\.(?= )|[\w'’-]*)", run.group())]
        used = -1
        for k, (w, at) in enumerate(toks):
            bare = re.sub(r"['’]s?$", "", w)
            if k <= used or not lex.is_surname(bare):
                continue
            end = at + len(bare)
            j, given, initials = k, 0, 0
            while j - 1 > used:
                p, pat = toks[j - 1]
                gap = text[pat + len(p) : toks[j][1]]
                if gap == " " and re.fullmatch(_INITIAL, p):
                    initials += 1
                elif gap == " " and len(p) == 1 and j == k:
                    initials += 1
                elif gap in (" ", ".") and given < 3 and lex.is_given(p, strict=given > 0 or initials > 1):
                    given += 1
                else:
                    break
                j -= 1
            if given or initials:
                used = k
                yield toks[j][1], end
                continue
            if k + 1 < len(toks):
                n, nat = toks[k + 1]
                nb = re.sub(r"['’]s?$", "", n)
                if text[at + len(w) : nat] in (", ", ",") and w == bare and (lex.is_given(nb) or re.fullmatch(_INITIAL, n)):
                    last, stop = k + 1, nat + len(nb)
                    while last + 1 < len(toks) and text[toks[last][1] + len(toks[last][0]) : toks[last + 1][1]] == " ":
                        q, qat = toks[last + 1]
                        if not (re.fullmatch(_INITIAL, q) or lex.is_given(q, strict=True)):
                            break
                        last, stop = last + 1, qat + len(q)
                    # A given name that has a surname of its own on its right belongs to that one.
                    if not (last + 1 < len(toks) and text[toks[last][1] + len(toks[last][0]) : toks[last + 1][1]] == " " and lex.is_surname(re.sub(r"['’]s?$", "", toks[last + 1][0]))):
                        used = last
                        yield at, stop
                        continue
            if re.search(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.? $", text[max(0, at - 7) : at]):
                used = k
                yield at, end


def _small_names(text: str, lex: Lexicon) -> Iterator[tuple[int, int]]:
    """Names typed without capitals: a word with a surname's ending beside a known first name or an initial."""
    if lex.small is None:
        return
    for m in lex.small.finditer(text):
        if not lex.is_surname(m.group()):
            continue
        left = re.search(r"(?<![\w@./#:-])((?:[^\W\d_](?:[\w'’-]*[^\W_])?\.? ){1,3})$", text[max(0, m.start() - 40) : m.start()])
        at, given = m.start(), 0
        for w in reversed(left.group(1).split() if left else []):
            if not (lex.is_given(w, strict=True) or (re.fullmatch(r"[^\W\d_]\.?", w) and (given or w.endswith(".")))):
                break
            given, at = given + 1, at - len(w) - 1
        if given:
            yield at, m.end()
            continue
        right = re.match(r", ?([^\W\d_][\w'’-]*)", text[m.end() :])
        if right and lex.is_given(right.group(1), strict=True):
            yield m.start(), m.end() + right.end()


def _address(text: str, m: re.Match) -> tuple[int, int]:
    """Where an address ends; a point after an abbreviated street type is its own unless it ends the sentence."""
    if m.group("en") is None:
        return m.start(), m.end()
    if m.group("rest") or not m.group("dot"):
        return m.start(), m.end()
    after = text[m.end() : m.end() + 3]
    if after[:1] == ".":
        return m.start(), m.end()
    ends = after == "" or re.match(r"\s+(?:\W|[A-ZÀ-Þ])|</|\s*$", after) is not None
    if ends and after[:1] == "\n" and not re.search(r"\.\n", text[: m.start()] + text[m.end() + 1 :]):
        ends = False
    if ends and after.startswith(" -"):
        ends = False
    return m.start(), m.end() - (1 if ends else 0)


def find_spans(text: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces in a text, in order; the surer kinds claim their place first."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []

    def claim(a: int, b: int, kind: str) -> None:
        if a < b and all(b <= s or a >= e for s, e, _ in spans):
            spans.append((a, b, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            claim(m.start(), m.end(), EMAIL)
    if any(c.isdigit() for c in text):
        for m in _ID.finditer(text):
            if id_score(m.lastgroup or "", m.group(), text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]) >= THRESHOLD - 0.15:
                claim(m.start(), m.end(), ID_NUMBER)
        for m in _PHONE.finditer(text):
            if phone_score(m.group(), text[max(0, m.start() - 30) : m.start()]) >= THRESHOLD - 0.05:
                claim(m.start(), m.end(), PHONE)
        for m in _ADDRESS.finditer(text):
            claim(*_address(text, m), STREET_ADDRESS)
    for a, b in _names(text, lex):
        claim(a, b, NAME)
    for a, b in _small_names(text, lex):
        claim(a, b, NAME)
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _added_up(values: DataFrame, count: Callable[[list], dict[str, list[int]]], label: str) -> DataFrame:
    """``w, a, b, c``: what ``count`` says of the single column ``values``, counted where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), *(pa.array([v[k] for v in got.values()], pa.int64()) for k in range(3))], names=["w", "a", "b", "c"])

    counted = spread(values).mapInArrow(run, "w string, a long, b long, c long")
    return materialise(counted.groupBy("w").agg(*(F.sum(c).alias(c) for c in "abc")), label)


def fit_lexicon(names: DataFrame, texts: DataFrame) -> Lexicon:
    """From all names (``key, name``) and whole texts (``key, text``); words are collected as far as they can matter."""
    named, seen = _added_up(names.select(names.columns[1]), count_names, "names"), _added_up(texts.select(texts.columns[1]), count_words, "words")
    surnames, end = named.where("w <> '' and b > 2 * a"), F.right("w", F.lit(3))
    counts = {r["e"]: r["n"] for r in surnames.where("length(w) >= 6").groupBy(end.alias("e")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").collect()}
    ends = usual_ends(counts, surnames.count())
    got = [
        {r["w"]: [r["a"], r["b"], r["c"]] for r in df.collect()}
        for df in (named.where(F.expr("w = '' or a >= 2 and a > 2 * b or b >= 2 and b > 2 * a") | F.expr("b > 2 * a") & end.isin(sorted(ends))), seen.where("w = '' or a >= 2"))
    ]
    lex = Lexicon([], [])
    lex.learn(*got, ends)
    discard(named)
    discard(seen)
    return lex


def personal_pieces(texts: DataFrame, lex: Lexicon, redacted: bool = False) -> DataFrame:
    """``src, row_id, pii_kind, pii_text`` of every piece in ``texts`` (``src, row_id, text``), distinct in a row.

    With ``redacted``: ``src, row_id, n_pieces, redacted`` of every text instead, pieces replaced by placeholders.
    Texts are read whole where they lie, without a shuffle: pieces are distinct within a text, and a row key is
    unique in its table. NULL and empty texts hold no piece and come out of ``redacted`` as they are.
    """
    schema = pa.schema(
        [("src", pa.string()), ("row_id", pa.int64()), ("n_pieces", pa.int32()), ("redacted", pa.string())]
        if redacted
        else [("src", pa.string()), ("row_id", pa.int64()), ("pii_kind", pa.string()), ("pii_text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for src, row, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                spans = find_spans(t, lex)
                if redacted:
                    rows.append((src, row, len(spans), redact(t, spans) if t else t))
                elif spans:
                    rows += [(src, row, k, x) for k, x in dict.fromkeys((k, t[a:e]) for a, e, k in spans)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "src string, row_id long, " + ("n_pieces int, redacted string" if redacted else "pii_kind string, pii_text string")
    return spread(texts.select("src", F.col("row_id").cast("long"), "text")).mapInArrow(run, ddl)


def union_texts(parts: list[tuple[str, DataFrame, str]], key: str = "row_id") -> DataFrame:
    """``src, row_id, text`` of several tables: (name, table, text column) each."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("src"), F.col(key).alias("row_id"), F.col(c).alias("text")) for n, df, c in parts])
