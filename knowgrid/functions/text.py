"""Text as Column expressions: tokens, slugs, titles, paths, secrets, labels. Python only for folding and stemming
distinct words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from knowgrid.functions import words as W
from knowgrid.functions.stem import stem


@F.pandas_udf(StringType())
def _fold_any(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn"))


def _latin_table() -> tuple[str, str]:
    """Latin letters that fold to one letter, and these; from the Unicode tables."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column | str) -> Column:
    """Compatibility forms and diacritics removed: Latin letters where the text is read; other scripts, compatibility
    forms and separate marks in Python, which sees only texts that hold any."""
    c = F.col(c) if isinstance(c, str) else c
    light = F.translate(c, *_latin_table())
    plain = light.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, light).otherwise(_fold_any(F.when(~plain, c)))


@F.pandas_udf(StringType())
def stem_word(s: pd.Series) -> pd.Series:
    """Porter2 stem; apply it to distinct words and join back."""
    return s.map(lambda x: None if x is None else stem(x))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, two bytes or more, without stop words, in order and with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.octet_length(w) >= 2) & ~w.isin(W.STOPWORDS))


def ascii_tokens(text: Column) -> Column:
    """As ``tokens`` for text that is folded already: ASCII letters and digits only."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(W.STOPWORDS))


def raw_words(text: Column) -> Column:
    """Lower-case ASCII words, nothing removed."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))


def slug(c: Column) -> Column:
    """Lower case, every run of other characters one hyphen, none at the ends (``fold`` first for accents)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+$", "")


def topic_id(c: Column) -> Column:
    """Slug under its canonical spelling."""
    s = slug(c)
    table = F.create_map(*[F.lit(x) for pair in W.TOPIC_ALIASES.items() for x in pair])
    return F.coalesce(F.when(s.isin(*W.TOPIC_ALIASES), table[s]), s)


def title_tokens(c: Column) -> Column:
    """Words of a title, three letters or more, without generic ones."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted({*W.CODE_STOP, *W.NOISE_WORDS})))


def phrase_tokens(c: Column) -> Column:
    """Title words, then each two neighbours joined by a hyphen."""
    t = title_tokens(c)
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws("-", F.element_at(t, i), F.element_at(t, i + 1)))
    return F.when(F.size(t) >= 2, F.concat(t, pairs)).otherwise(t)


def is_subject(c: Column) -> Column:
    """More letters than digits."""
    return F.length(F.regexp_replace(c, "[^a-z]", "")) > F.length(F.regexp_replace(c, "[^0-9]", ""))


def reads_as_name(c: Column) -> Column:
    """No part between hyphens is empty, grammar, or begins with a digit."""
    return F.when(c == "", False).otherwise(F.forall(F.split(c, "-"), lambda w: (w != "") & ~w.isin(W.GRAMMAR_WORDS) & ~w.rlike("^[0-9]")))


def path_topics(path: Column) -> Column:
    """Subjects in a path: its technology, then the names of its segments and the words inside them, repeats kept."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    by_ext = F.create_map(*[F.lit(x) for p in W.EXTENSION_TOPICS.items() for x in p])
    by_file = F.create_map(*[F.lit(x) for p in W.FILE_TOPICS.items() for x in p])
    tech = F.array_compact(F.array(F.when(base.isin(*W.FILE_TOPICS), by_file[base]).when(ext.isin(*W.EXTENSION_TOPICS), by_ext[ext])))
    segments = F.filter(F.split(path, "/"), lambda s: ~s.startswith(".") & (F.regexp_replace(s, r"^[*?.]+|[*?.]+$", "") != ""))
    parts = F.flatten(F.transform(segments, lambda s: F.split(F.lower(F.regexp_replace(s, r"^[*?.]+|[*?.]+$", "")), r"\.")))
    good = F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(W.CODE_STOP) & is_subject(w))
    inner = lambda w: F.filter(F.split(w, "[_-]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*sorted({*W.CODE_STOP, *W.GRAMMAR_WORDS})) & is_subject(x))
    return F.concat(tech, F.flatten(F.transform(good, lambda w: F.when(w.rlike("[_-]"), F.concat(F.array(w), inner(w))).otherwise(F.array(w)))))


def fold_group_name(c: Column) -> Column:
    """A group's name without its permission tier."""
    n = F.lower(F.trim(c))
    out = n
    for s in reversed(W.PERMISSION_SUFFIXES):
        out = F.when(n.endswith(s) & (F.length(n) > len(s)), F.substring(n, F.lit(1), F.length(n) - len(s))).otherwise(out)
    return out


def scrub(c: Column) -> tuple[Column, Column]:
    """Text with credentials replaced by ``[redacted]``, and how many there were."""
    found, out = F.lit(0), c
    for i, p in enumerate(W.SECRET_PATTERNS):
        keep = {len(W.SECRET_PATTERNS) - 1: "$1$2[redacted]", len(W.SECRET_PATTERNS) - 2: "$1 [redacted]"}.get(i, "[redacted]")
        found = found + F.regexp_count(out, F.lit(p))
        out = F.regexp_replace(out, p, keep)
    return out, found


def is_role_mailbox(address: Column) -> Column:
    """Whether a normalised address is a shared mailbox."""
    return F.coalesce(F.substring_index(address, "@", 1).isin(W.ROLE_LOCALS) & (F.instr(address, "@") > 1), F.lit(False))


def _bot_word(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-_. +]+", " ").rlike(r"(^| )(bot|robot|mergebot|dependabot|renovatebot)( |$)")


def is_automation(name: Column, address: Column) -> Column:
    """Whether an author is a machine."""
    local = F.regexp_replace(F.substring_index(address, "@", 1), r"^[^+]*\+", "")
    named = F.lower(F.trim(name)).isin(*W.AUTOMATION_NAMES) | F.lower(F.trim(local)).isin(*W.AUTOMATION_NAMES)
    return F.coalesce(name.endswith("[bot]"), F.lit(False)) | F.coalesce(address.contains("[bot]"), F.lit(False)) | F.coalesce(named, F.lit(False)) | F.coalesce(_bot_word(name), F.lit(False)) | F.coalesce(_bot_word(local), F.lit(False))


def same_family(a: Column, b: Column) -> Column:
    """Whether one name holds the other, or is a word of it."""
    return a.contains(b) | b.contains(a) | F.array_contains(F.split(a, "[_-]+"), b) | F.array_contains(F.split(b, "[_-]+"), a)


def topic_repeat(n: Column) -> Column:
    """Touches to repeats: one for one up to four, then logarithmic, sixteen at most."""
    return F.when(n <= 4, n).otherwise(F.least(F.lit(16), F.round(4 * (1 + F.log(n / 4.0))))).cast("int")


def strength_label(c: Column) -> Column:
    return F.when(c >= 0.75, "strong").when(c >= 0.45, "moderate").when(c > 0, "weak").otherwise("none")


def decay(at: Column, as_of: str, half_life_days: float = 180.0) -> Column:
    """2^(-age / half-life); undated and future evidence doesn't decay."""
    now = F.to_timestamp(F.lit(as_of))
    age = (F.unix_micros(now) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(at.isNull() | (age <= 0), 1.0).otherwise(F.pow(F.lit(2.0), -age / half_life_days))


def truncate_bytes(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut between characters.

    The bytes are cut first; of a character cut apart, which starts within the last three bytes, nothing is kept.
    """
    cut = F.hex(F.substring(c.cast("binary"), 1, limit))
    # A lead byte (C0 and up) with fewer followers (80 to BF) than it announces: one, two or three.
    whole = F.regexp_replace(cut, r"(?:[CDEF][0-9A-F]|[EF][0-9A-F][89AB][0-9A-F]|F[0-9A-F](?:[89AB][0-9A-F]){2})$", "")
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.unhex(whole).cast("string"))


def stemmed_vocabulary(words: DataFrame, col: str = "token") -> DataFrame:
    """``token, stem`` of the distinct words: Python sees each word once."""
    return words.select(F.col(col).alias("token")).distinct().withColumn("stem", stem_word("token"))
