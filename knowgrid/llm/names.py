"""Variant spellings of names typed by people: names sharded into tries, Levenshtein automata, evidence, groups."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowgrid.llm.components import connected_groups
from knowgrid.session import discard, materialise, spread

#: Names that one trie holds; a shard with more is split and its queries go to every part.
TRIE_NAMES = 20_000
#: Asked names that one task leads through a trie; a shard with more is split, too.
ASKED_NAMES = 50_000
#: Edits between a typed name and a known one.
MAX_EDITS = 2

# Marks and words around a name that aren't part of it, and words of company names.
_NOISE = re.compile(r"\[[^\]]*\]|\((?:contractor|ext|external|intern|temp|vendor)\)|\s-\s*(?:on leave|ooo|away|left|contractor|external)\b.*$|\b(?:ph\.?\s?d|jr|sr|mba|md|esq|ii|iii|iv)\b\.?|\b(?:dr|mr|mrs|ms|prof)\.", re.I)
_NICK = re.compile(r"[\"“”«»(][^\"“”«»()]*[\"“”«»)]")
COMPANY_WORDS = set(
    "the inc ltd llc gmbh ag sa co corp corporation company limited group holdings systems sys software soft consulting consltg engineering eng international intl "
    "industries services technologies tech solutions partners associates incorporated labs global mbh bv plc kg and".split()
)
PLACEHOLDERS = {"", "unknown", "none", "null", "n a", "na", "tbd", "test", "admin", "user", "x", "no name", "nobody"}
_CYRILLIC = str.maketrans("аеорсухіјѕԁкмтвнгвАЕОРСУХІ", "aeopcyxijsdkmtbhrbAEOPCYXI")
_LEET = str.maketrans("013457", "oieast")
_SPECIAL = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ı": "i", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe"})


def plain(s: str) -> str:
    """Lower case without accents, invisible characters and look-alike letters."""
    s = unicodedata.normalize("NFKD", s.translate(_SPECIAL))
    return "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(_CYRILLIC).lower()


def name_tokens(name: str | None) -> list[str]:
    """The words of a typed name, in the order given name first where a comma or capitals tell; digits read as letters."""
    if not name:
        return []
    s = _NICK.sub(" ", _NOISE.sub(" ", unicodedata.normalize("NFKC", name).replace("​", "")))
    s = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", s)
    if s.count(",") == 1:
        a, b = s.split(",")
        s = f"{b} {a}"
    out = []
    for w in re.split(r"[\s._/|]+", s):
        p = plain(w)
        if re.search(r"[a-z]", p) and re.search(r"\d", p):
            p = p.translate(_LEET)
        p = re.sub(r"[^a-z-]", "", p).strip("-")
        out += p.split("-") if any(x in COMPANY_WORDS for x in p.split("-")) else [p]
    return [p for p in out if p]


def _places(word: str) -> dict[str, int]:
    """Where each letter stands in a word, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance (a swap of neighbours counts one) is at most ``k``, which is two at most."""
    if a == b:
        return True
    if k < 1 or abs(len(a) - len(b)) > k:
        return False
    t = Trie()
    t.add(b, None)
    return bool(t.near(a, k))


class Trie:
    """Names by their letters; ``near`` walks it with a Levenshtein automaton.

    The automaton's state is a set of bits for each number of edits: bit ``i`` of the ``j``-th tells that ``i`` letters
    of the word can be spent on the path so far with ``j`` edits. A branch is left as soon as no bit is set. A path
    with a single name below it is kept as one string.
    """

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value: object) -> None:
        node, i = self.root, 0
        while i < len(word):
            c = word[i]
            i += 1
            got = node.get(c)
            if got is None:
                node[c] = (word[i:], [value])
                return
            if isinstance(got, tuple):
                rest, values = got
                if rest == word[i:]:
                    values.append(value)
                    return
                below: dict = {}
                if rest:
                    below[rest[0]] = (rest[1:], values)
                else:
                    below[""] = values
                node[c] = got = below
            node = got
        node.setdefault("", []).append(value)

    def near(self, word: str, k: int) -> list[tuple[int, object]]:
        """(distance, value) of the names at most ``k`` (two at most) edits away, swaps included."""
        n, out, at = len(word), [], _places(word)
        full, goal = (1 << n + 1) - 1, 1 << n
        if "" in self.root and n <= k:
            out += [(n, v) for v in self.root[""]]
        # A node with the state on the way to it, the state a letter before, and that letter's places.
        todo = [(self.root, 1, 3 & full, 7 & full, 0, 0, 0)]
        while todo:
            node, r0, r1, r2, o0, o1, last = todo.pop()
            for c, below in node.items():
                if not c:
                    continue
                m = at.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = ((r1 & m) << 1 | r0 | r0 << 1 | s0 << 1 | (o0 & m & last >> 1) << 2) & full
                if k == 1:
                    s2 = 0
                    if not s1:
                        continue
                else:
                    s2 = ((r2 & m) << 1 | r1 | r1 << 1 | s1 << 1 | (o1 & m & last >> 1) << 2) & full
                    if not s2:
                        continue
                if type(below) is dict:
                    if "" in below:
                        d = 0 if s0 & goal else 1 if s1 & goal else 2 if s2 & goal else 9
                        if d <= k:
                            out += [(d, v) for v in below[""]]
                    todo.append((below, s0, s1, s2, r0, r1, m))
                    continue
                t0, t1, t2, p0, p1, before = s0, s1, s2, r0, r1, m
                for c in below[0]:
                    m = at.get(c, 0)
                    u0 = (t0 & m) << 1
                    u1 = ((t1 & m) << 1 | t0 | t0 << 1 | u0 << 1 | (p0 & m & before >> 1) << 2) & full
                    u2 = 0 if k == 1 else ((t2 & m) << 1 | t1 | t1 << 1 | u1 << 1 | (p1 & m & before >> 1) << 2) & full
                    if not u1 and not u2:
                        t0 = t1 = t2 = 0
                        break
                    t0, t1, t2, p0, p1, before = u0, u1, u2, t0, t1, m
                d = 0 if t0 & goal else 1 if t1 & goal else 2 if t2 & goal else 9
                if d <= k:
                    out += [(d, v) for v in below[1]]
        return out


def _shortened(w: str, k: int) -> set[str]:
    """A word without up to ``k`` of its letters: words within ``k`` edits have one of these in common."""
    out, last = {w}, {w}
    for _ in range(k):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return out


def habit_counts(rows: Iterable[tuple[str | None, str | None]]) -> tuple[dict[str, list], Counter]:
    """What ``Habits`` are learned from, of any part of the rows (``name, email``).

    By word: addresses that hold it, names typed with it in front and at the end, and the least and the greatest of the
    words that share an address of two with it. By (word, first name, surname): how often the word was typed beside the
    surname where the address has the first name. Addresses of companies hold no first name.
    """
    words: dict[str, list] = defaultdict(lambda: [0, 0, 0, None, None])
    typed: Counter = Counter()
    for name, email in rows:
        toks, address = name_tokens(name), _address(email)
        loc = [] if address is None or company_label(*address, toks) else _split_local(email)
        if len(toks) == 2:
            words[toks[0].replace("-", "")][1] += 1
            words[toks[1].replace("-", "")][2] += 1
        elif len(toks) == 3:
            words[(toks[0] + toks[1]).replace("-", "")][1] += 1
        for w in set(loc):
            words[w][0] += 1
        if len(loc) == 2:
            for g, s in (loc, loc[::-1]):
                of = words[g]
                of[3:] = (s, s) if of[3] is None else (min(of[3], s), max(of[4], s))
                if len(toks) == 2:
                    for a, b in (toks, toks[::-1]):
                        if b.replace("-", "") == s and len(a) > 1 and a.replace("-", "") != g:
                            typed[a.replace("-", ""), g, s] += 1
    return words, typed


class Habits:
    """First names as addresses spell them, and what people type for them (nicknames)."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        words, typed = habit_counts(rows)
        given = {w for w, (parts, first, last, lo, hi) in words.items() if len(w) > 1 and parts >= 2 and first > 2 * last and first >= 2 and lo != hi}
        found: Counter = Counter()
        for (a, g, s), k in typed.items():
            if a not in given and g in given and s not in given:
                found[a, g] += k
        self.learn(given, [x for x, k in found.items() if k >= 2])

    def learn(self, given: set[str], nick: Iterable[tuple[str, str]]) -> None:
        """First names, and (typed word, first name) of what is typed for them.

        A first name stands beside different words in addresses: the name of a company that is cut in two when typed, or
        the surname of a single person typed in front, doesn't, however many rows there are.
        """
        self.given = given
        self.nick: dict[str, set[str]] = defaultdict(set)
        for w, g in nick:
            self.nick[w].add(g)
        self.nick = dict(self.nick)
        self.memo: dict[str, set[str]] = {}
        self.lengths = sorted({len(w) for w in self.given})
        self.shortened: dict[str, set[str]] = defaultdict(set)
        for w in self.given:
            for x in _shortened(w, 2):
                self.shortened[x].add(w)

    def givens(self, w: str) -> set[str]:
        """The first names that a typed word may stand for."""
        w = w.replace("-", "")
        if w in self.given:
            return {w}
        got = self.memo.get(w)
        if got is None:
            got = set(self.nick.get(w, ()))
            if len(w) >= 3:
                k = 1 if len(w) < 6 else 2
                near = set() if got or len(w) > 40 else set().union(*(self.shortened.get(x, ()) for x in _shortened(w, k)))
                got |= {g for g in near if within(w, g, k)}
            self.memo[w] = got
        return got


def _address(email: str | None) -> tuple[str, str] | None:
    """Local part and domain of one mailbox, normalised; None for anything else."""
    m = re.search(r"<([^<>]*)>", email or "")
    e = (m[1] if m else email or "").strip().strip("  ").lower()
    if not re.fullmatch(r"[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+", e):
        return None
    local, domain = e.split("@")
    if ".noreply." in f".{domain}" or domain.startswith("users.noreply"):
        return local, domain
    return local.split("+")[0], domain


def _login(local: str, domain: str) -> str:
    """The local part that names somebody: at a no-reply host what follows the number."""
    return local.split("+", 1)[-1] if "noreply" in domain else local


def _split_local(email: str | None) -> list[str]:
    a = _address(email)
    return [] if a is None else [w for w in re.split(r"[._-]", re.sub(r"\d+$", "", _login(*a))) if w]


def parse_local(local: str, tokens: list[str], habits: Habits) -> tuple[str, str, str] | None:
    """(surname, first name or initial, digits) that a local part spells, helped by the name typed beside it."""
    m = re.fullmatch(r"(.*?)(\d*)", local)
    base, digits = m[1], m[2]
    t = [w for w in re.split(r"[._-]", base) if w]
    if len(t) == 2:
        a, b = t
        if b in habits.given and a not in habits.given or len(b) == 1 < len(a):
            return a, b, digits
        return b, a, digits
    if len(t) != 1 or len(t[0]) < 3:
        return None
    w = t[0]
    if len(w) < 5:
        # So short a word names somebody only if the surname stands beside it as it is.
        return (w[1:], w[0], digits) if w[1:] in tokens and any(x[0] == w[0] for x in tokens if x != w[1:]) else None
    heads = [(w[n:], w[:n]) for n in habits.lengths if len(w) - n >= 2 and w[:n] in habits.given]
    tails = [(w[:-n], w[-n:]) for n in habits.lengths if len(w) - n >= 2 and w[-n:] in habits.given]
    typed = [x.replace("-", "") for x in tokens]
    options = [x for x in heads + tails if len(x[0]) >= 4 or x[0] in typed]
    near = lambda s: any(within(s, x, 2) for x in typed)
    options = [(-near(x[0]), -len(x[1]), x) for x in options]
    options.sort()
    if near(w[1:]) and not (options and options[0][0]):
        return w[1:], w[0], digits
    if options:
        return options[0][2][0], options[0][2][1], digits
    return w[1:], w[0], digits


def company_label(local: str, domain: str, tokens: list[str] = []) -> str | None:
    """The label of a domain that belongs to one company: its own name stands in the local part, or it is a desk.

    A label of fewer than ten letters must also be typed beside the address, since many domains have such names.
    """
    label = domain.split(".")[0]
    if len(label) < 10 and not (len(label) >= 3 and (label in tokens or label == "".join(w for w in tokens if w not in COMPANY_WORDS))):
        return None
    if label in local or local in ("info", "contact", "team", "sales", "office", "hello", "support", "billing", "mail"):
        return label
    return None


def guesses(toks: list[str], habits: Habits, company: bool = True) -> list[tuple[str, str, str]]:
    """(kind, surname or company, first name) of the typed words, each taken as the surname with every other one as
    the first name: what the trie join asks for."""
    out: list[tuple[str, str, str]] = []
    words = [w for w in toks if w not in COMPANY_WORDS]
    if company and words and (len(words) < len(toks) or len(words) == 1 and len(words[0]) >= 10):
        out.append(("C", max(words, key=len), ""))
    pairs = set()
    forms = [w.replace("-", "") for w in words]
    if len(forms) >= 3:
        forms.append(forms[0] + forms[1])
    for i, g in enumerate(forms):
        firsts = habits.givens(g) or ({g} if len(g) == 1 else set())
        pairs |= {(f, s) for j, s in enumerate(forms) if i != j and len(s) >= 2 for f in firsts}
    return out + [("P", s, f) for f, s in sorted(pairs)]


def read_mention(name: str | None, email: str | None, habits: Habits) -> dict:
    """What one (name, address) pair tells: keys of the address, person (surname, first name) or company, guesses."""
    toks = name_tokens(name)
    if " ".join(toks) in PLACEHOLDERS:
        toks = []
    out = {"keys": [], "company": None, "surname": None, "given": None, "initial": None, "digit": "", "guess": [], "spelt": None}
    a = _address(email)
    words = [w for w in toks if w not in COMPANY_WORDS]
    if a is not None:
        local, domain = a
        out["keys"].append(f"E:{local}@{domain}")
        out["company"] = company_label(local, domain, toks)
        if out["company"]:
            return out
        login = _login(local, domain)
        out["keys"].append("L:" + re.sub(r"[_-]", ".", login))
        p = parse_local(login, toks, habits)
        if p:
            s, g, digits = p
            out["surname"], out["initial"] = s, g[0]
            out["digit"] = digits if len(digits) == 1 else ""
            if len(g) > 1:
                out["given"] = g
            else:
                fits = {x for w in toks if not within(w.replace("-", ""), s, 2) for x in habits.givens(w) if x[0] == g}
                joined = "".join(toks[:2]).replace("-", "")
                if joined in habits.given and joined[0] == g:
                    fits = {joined}
                if len(fits) == 1:
                    out["given"] = fits.pop()
        out["guess"] = guesses(toks, habits, company=False)
        # Does the address name the person that was typed beside it? Only then may it overrule the typed name.
        out["spelt"] = p is not None and (len(re.split(r"[._-]", login)) > 1 or any(within(p[0], w.replace("-", ""), 2) for w in toks))
        return out
    out["guess"] = guesses(toks, habits)
    forms = [w.replace("-", "") for w in words]
    if not any(k == "P" for k, _, _ in out["guess"]) and len(forms) == 1 and forms[0] in habits.given:
        out["given"], out["initial"] = forms[0], forms[0][0]
    return out


_MENTION = pa.schema(
    [("rec_id", pa.int64()), ("keys", pa.list_(pa.string())), ("company", pa.string()), ("surname", pa.string()), ("given", pa.string()), ("initial", pa.string()), ("digit", pa.string()),
     ("guess", pa.list_(pa.string())), ("sig", pa.list_(pa.string())), ("spelt", pa.bool_())]
)
_MENTION_DDL = "rec_id long, keys array<string>, company string, surname string, given string, initial string, digit string, guess array<string>, sig array<string>, spelt boolean"


def read_mentions(rows: DataFrame, habits: Habits) -> DataFrame:
    """``rec_id, name, email, title, team, org, manager`` to what each pair of name and address tells."""

    def tidy(x: str | None) -> str | None:
        p = re.sub(r"\s+", " ", plain(x)).strip() if x else ""
        return p or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _MENTION]
            for rec, name, email, title, team, org, manager in zip(*(c.to_pylist() for c in b.columns)):
                m = read_mention(name, email, habits)
                boss = _address(manager)
                sig = [tidy(title), tidy(team), tidy(org), "@".join(boss) if boss else None]
                guess = [f"{k}|{s}|{g}" for k, s, g in m["guess"]]
                for c, v in zip(cols, (rec, m["keys"], m["company"], m["surname"], m["given"], m["initial"], m["digit"], guess, sig, m["spelt"])):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MENTION)], schema=_MENTION)

    return spread(rows.select("rec_id", "name", "email", "title", "team", "org", "manager")).mapInArrow(run, _MENTION_DDL)


def _shard_keys(q: Column, asked: bool) -> Column:
    """Where a name is filed, so that every name within its edits shares a shard with the one that is asked for.

    One edit leaves an end of the surname whole. Two do, or each of them spoils one end and the middle letter keeps
    its place but for one; the first name is the same. Surnames of up to seven letters, of which one edit may
    spoil as much, are filed by their first and last letter with the first name, of up to three by the first name
    alone. Where only an initial was typed, four letters at an end must be whole.
    """
    part = F.split(q, r"\|")
    s, g = part[1], part[2]
    initial, n = F.substring(g, 1, 1), F.length(s)
    key = lambda kind, *c: F.concat(F.lit(kind), *c)
    places = (F.substring(s, i, 1) for i in ((3, 4, 5) if asked else (4,)))
    middle = [F.when(n >= 7, x) for x in places]
    company = [key("C<", F.substring(s, 1, 4)), key("C>", F.right(s, F.lit(4))), *[key("C=", x) for x in middle]]
    ends = [key("P<", initial, F.substring(s, 1, 4)), key("P>", initial, F.right(s, F.lit(4)))]
    named = [
        key("G<", g, F.substring(s, 1, 2)), key("G>", g, F.right(s, F.lit(2))), *[key("G=", g, F.lit("|"), x) for x in middle],
        F.when(n <= 7, key("S<", g, F.substring(s, 1, 1))), F.when(n <= 7, key("S>", g, F.right(s, F.lit(1)))),
        F.when(n <= (2 if asked else 3), key("S=", g)),
    ]
    return F.array_distinct(F.array_compact(F.when(part[0] == "C", F.array(*company)).when(F.length(g) > 1, F.array(*ends, *named)).otherwise(F.array(*ends))))


def trie_join(known: DataFrame, asked: DataFrame, max_edits: int = MAX_EDITS, trie_names: int = TRIE_NAMES, asked_names: int = ASKED_NAMES) -> DataFrame:
    """``q, hit, edits``: the known names (``kind|surname|first``) at most ``max_edits`` edits from each asked one, one
    where the asked surname has fewer than seven letters. An initial stands for every first name that it begins.

    Each shard's names form a trie that the asked names of the shard traverse with Levenshtein automata. A shard
    of over ``trie_names`` known or ``asked_names`` asked names is split: every part of the ones meets every part of
    the others, in a task of its own. One trie is in memory at a time.
    """
    d = known.select(F.col("q").alias("name"), F.explode(_shard_keys(F.col("q"), False)).alias("k"))
    a = asked.select(F.col("q").alias("name"), F.explode(_shard_keys(F.col("q"), True)).alias("k"))
    # Only shards that somebody asks for are built.
    pieces = lambda x, most, c: x.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(c))
    plan = pieces(d, trie_names, "parts").join(pieces(a, asked_names, "slices"), ["k"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("name"), F.col(c)).cast("int")
    d = d.join(plan, ["k"]).select("k", own("parts").alias("p"), every("slices").alias("s"), F.lit(0).alias("side"), "name")
    a = a.join(plan, ["k"]).select("k", every("parts").alias("p"), own("slices").alias("s"), F.lit(1).alias("side"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, initials = None, Trie(), Trie()
        for b in batches:
            q, hit, edits = [], [], []
            for k, p, part, side, name in zip(*(c.to_pylist() for c in b.columns)):
                if (k, p, part) != at:
                    at, trie, initials = (k, p, part), Trie(), Trie()
                kind, s, g = name.split("|")
                if side == 0:
                    trie.add(f"{s}|{g}", name)
                    if kind == "P" and k[0] == "P":
                        initials.add(f"{s}|{g[:1]}", name)
                else:
                    limit = max_edits if len(s) >= 7 else min(1, max_edits)
                    found: dict = {}
                    for e, v in (initials if kind == "P" and len(g) == 1 else trie).near(f"{s}|{g}", limit):
                        found[v] = min(e, found.get(v, 9))
                    q += [name] * len(found)
                    hit += found
                    edits += found.values()
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(hit), pa.array(edits, pa.int32())], names=["q", "hit", "edits"])

    both = d.unionByName(a).repartition("k", "p", "s").sortWithinPartitions("k", "p", "s", "side")
    return both.mapInArrow(run, "q string, hit string, edits int").groupBy("q", "hit").agg(F.min("edits").alias("edits"))


def typed_hits(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the typed names of mentions (as ``read_mentions`` gives them) ask for, and what the trie join finds for it.

    The first has a row for each mention and name asked for; the second ``rec_id, pair, hit, edits, sig, other, near``
    for each mention (``pair``) and known name that its typed name may stand for. Known are the names that addresses
    spell out, or an initial's address together with the name typed beside it.
    """
    spelt = m.where("surname is not null and given is not null").select(F.concat_ws("|", F.lit("P"), "surname", "given").alias("q"))
    known = spelt.unionByName(m.where("company is not null").select(F.concat(F.lit("C|"), "company", F.lit("|")).alias("q"))).distinct()
    # A record may have several addresses; what each pair of name and address tells is weighed by itself.
    pair = F.xxhash64("rec_id", "keys", "guess", "sig")
    guess = m.where("size(guess) > 0").select("rec_id", pair.alias("pair"), "sig", "surname", "initial", "given", "spelt", F.explode("guess").alias("q"))
    hits = materialise(trie_join(known, guess.select("q").distinct()), "hits")
    h = F.split("hit", r"\|")
    # An address that spells a name overrules hits of other names, except those of the very words that were typed.
    agrees = (h[1] == F.col("surname")) & (F.substring(h[2], 1, 1) == F.col("initial"))
    told_by = F.coalesce("spelt", F.lit(False))
    found = guess.join(hits, ["q"]).where(~told_by | agrees | (F.col("edits") == 0))
    found = found.withColumn("other", told_by & (F.col("given").isNotNull() | ~agrees))
    found = found.groupBy("rec_id", "pair", "hit").agg(F.min("edits").alias("edits"), F.min("sig").alias("sig"), F.max("other").alias("other"))
    best = found.groupBy("pair", "other").agg(F.min("edits").alias("least"))
    return guess, materialise(found.join(best, ["pair", "other"]).withColumn("near", F.col("edits") == F.col("least")), "found")


def link_names(rows: DataFrame, habits: Habits) -> DataFrame:
    """``rec_id, group_id`` of records (``rec_id, name, email, title, team, org, manager``; several rows a record).

    A record is tied to keys: its addresses, their local parts, the company of its domain, and the person named:
    (surname, first name), as the address spells it, or, where there is none, as the trie join finds it among the
    known ones. A person's key alone ties only while nobody shares the name: if the records under it disagree in
    title, team and unit, or their addresses are numbered, they tie by these instead. Records and keys form a
    graph, whose connected groups are the people and organisations. NULLs, placeholders and blank names tie
    nothing; a record with neither is a group of its own.
    """
    m = materialise(read_mentions(rows, habits), "mentions")
    person = m.where("surname is not null and given is not null")
    guess, found = typed_hits(m)
    sure = found.where(~F.col("other")).groupBy("pair").agg(F.sum(F.col("near").cast("int")).alias("n_near"))
    met = found.select("pair").distinct()
    found = found.join(sure, ["pair"], "left").withColumn("h", F.split("hit", r"\|"))
    guess = guess.where(~F.coalesce("spelt", F.lit(False)))
    guessed = found.select(
        "rec_id",
        "sig",
        F.when(F.col("h")[0] == "C", F.col("h")[1]).alias("company"),
        F.when(F.col("h")[0] == "P", F.col("h")[1]).alias("surname"),
        F.when(F.col("h")[0] == "P", F.col("h")[2]).alias("given"),
        (~F.col("other") & F.col("near") & (F.col("n_near") == 1)).alias("sure"),
    )
    # Typed names that no known one is near to tie records of the very same words; with their unit they tie anyway.
    typed = guess.withColumn("h", F.split("q", r"\|")).select(
        "rec_id", "sig", F.when(F.col("h")[0] == "P", F.col("h")[1]).alias("surname"), F.when(F.col("h")[0] == "P", F.col("h")[2]).alias("given"), F.lit(False).alias("sure"), F.lit(None).cast("string").alias("word")
    ).where("surname is not null")
    alone = guess.where("spelt is null").join(met, ["pair"], "left_anti").groupBy("rec_id").agg(F.concat_ws("/", F.sort_array(F.collect_set("q"))).alias("word"))
    typed = typed.unionByName(alone.select("rec_id", F.array().cast("array<string>").alias("sig"), F.lit(None).cast("string").alias("surname"), F.lit(None).cast("string").alias("given"), F.lit(False).alias("sure"), "word"))
    told = m.select("rec_id", "keys", "company", "surname", "given", "initial", "digit", "sig", F.lit(True).alias("sure"))
    all_ = told.unionByName(
        guessed.select("rec_id", F.array().cast("array<string>").alias("keys"), "company", "surname", "given", F.substring("given", 1, 1).alias("initial"), F.lit("").alias("digit"), "sig", "sure")
    ).unionByName(
        typed.select("rec_id", F.when(F.col("word").isNotNull(), F.array(F.concat(F.lit("W:"), "word"))).otherwise(F.array().cast("array<string>")).alias("keys"), F.lit(None).cast("string").alias("company"), "surname", "given", F.substring("given", 1, 1).alias("initial"), F.lit("").alias("digit"), "sig", "sure")
    )
    title, team, org, boss = (F.get("sig", F.lit(i)) for i in range(4))
    full = title.isNotNull() & team.isNotNull() & org.isNotNull()
    # Namesakes: records of one name that disagree, or numbered addresses of it.
    sigs = told.where(full & F.col("surname").isNotNull() & F.col("given").isNotNull()).select("surname", "given", F.concat_ws("|", title, team, org).alias("s"))
    n_sigs = sigs.groupBy("surname", "given").agg((F.min("s") != F.max("s")).alias("split"))
    n_digits = person.groupBy("surname", "given").agg((F.min("digit") != F.max("digit")).alias("numbered"))
    state = n_digits.join(n_sigs, ["surname", "given"], "left").select("surname", "given", (F.coalesce("split", F.lit(False)) | F.col("numbered")).alias("shared"))
    # Records without a whole name have no namesakes to look up, and would all meet in one task.
    whole = F.col("surname").isNotNull() & F.col("given").isNotNull()
    all_ = all_.where(whole).join(state, ["surname", "given"], "left").unionByName(all_.where(~whole).withColumn("shared", F.lit(None).cast("boolean")))
    key = lambda *c: F.concat_ws("|", *c)
    named = F.col("surname").isNotNull() & F.col("given").isNotNull()
    keys = F.array_compact(
        F.concat(
            F.col("keys"),
            F.array(
                F.when(F.col("company").isNotNull() & F.col("sure"), key(F.lit("C"), "company")),
                F.when(named & F.col("sure") & ~F.coalesce("shared", F.lit(False)), key(F.lit("N"), "surname", "given")),
                F.when(named & (F.col("digit") != ""), key(F.lit("D"), "surname", "given", "digit")),
                F.when(named & full, key(F.lit("A"), "surname", "given", title, team, org)),
                F.when(F.col("surname").isNotNull() & full, key(F.lit("T"), "surname", "initial", title, team, org)),
                F.when(F.col("surname").isNotNull() & title.isNotNull() & team.isNotNull() & boss.isNotNull(), key(F.lit("B1"), "surname", "initial", title, team, boss)),
                F.when(F.col("surname").isNotNull() & title.isNotNull() & org.isNotNull() & boss.isNotNull(), key(F.lit("B2"), "surname", "initial", title, org, boss)),
                F.when(F.col("surname").isNotNull() & team.isNotNull() & org.isNotNull() & boss.isNotNull(), key(F.lit("B3"), "surname", "initial", team, org, boss)),
                F.when(F.col("initial").isNotNull() & full & boss.isNotNull(), key(F.lit("M"), "initial", title, team, org, boss)),
            ),
        )
    )
    rec = F.concat(F.lit("~"), F.col("rec_id").cast("string"))
    edges = all_.select(rec.alias("u"), F.explode_outer(keys).alias("v")).select("u", F.coalesce("v", "u").alias("v"))
    groups = connected_groups(materialise(edges.distinct(), "edges"))
    return groups.where(F.col("v").startswith("~")).select(F.substring("v", 2, 20).cast("long").alias("rec_id"), F.col("root").alias("group_id"))


def same_entity_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of records of one group, the smaller id first."""
    a = groups.select("group_id", F.col("rec_id").alias("rec_id_a"))
    b = groups.select("group_id", F.col("rec_id").alias("rec_id_b"))
    return a.join(b, ["group_id"]).where("rec_id_a < rec_id_b").select("rec_id_a", "rec_id_b")


def fit_habits(people: DataFrame) -> Habits:
    """From all rows of ``rec_id, name, email``: counted where they lie, and added up before anything is collected, which
    is first names and nicknames only."""
    schema = pa.schema([(c, pa.string()) for c in ("w", "g", "s")] + [(c, pa.int64()) for c in ("parts", "first", "last")] + [("lo", pa.string()), ("hi", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, typed = habit_counts(zip(*(c.to_pylist() for c in b.columns)))
            rows = [(w, None, None, *v) for w, v in words.items()] + [(*k, n, 0, 0, None, None) for k, n in typed.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    counted = spread(people.select("name", "email")).mapInArrow(run, "w string, g string, s string, parts long, first long, last long, lo string, hi string")
    counts = materialise(counted.groupBy("w", "g", "s").agg(*(F.sum(c).alias(c) for c in ("parts", "first", "last")), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "habits")
    given = counts.where("g is null and length(w) > 1 and parts >= 2 and first > 2 * last and first >= 2 and lo <> hi").select("w")
    typed = counts.where("g is not null").select("w", "g", "s", "parts").join(given.select(F.col("w").alias("g")), ["g"], "left_semi")
    for c in ("w", "s"):
        typed = typed.join(given.select(F.col("w").alias(c)), [c], "left_anti")
    nick = typed.groupBy("w", "g").agg(F.sum("parts").alias("n")).where("n >= 2")
    habits = Habits([])
    habits.learn({r["w"] for r in given.collect()}, [(r["w"], r["g"]) for r in nick.collect()])
    discard(counts)
    return habits
