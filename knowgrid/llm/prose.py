"""Words of a text behind its typography, shared by the leak search and the language labeller."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from functools import cache

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"[-‐\u00ad](?<=\w[-‐\u00ad])\s*\n[\s>#*|]*(?=[^\W\d_])")
_QUOTE_PREFIX = re.compile(r"^[ \t]*(?:(?:[>*#|+]|-(?=\s))[ \t]*)+", re.M)
_MARK = re.compile(r"[*_`~]+")
_WORD = re.compile(r"[^\W_]+")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁԛԝгкмтвнοανρκτυι", "aeopcyxijsdqwrkmtbhoavpktui")
_LOOKALIKE_SAFE = str.maketrans("аеорсухіј", "aeopcyxij")
_QUOTES = re.compile(r"[’‘ʼ`´']")


@cache
def _invisible() -> tuple[frozenset[str], dict[int, None]]:
    """Format characters but for the soft hyphen, which may stand in a broken word."""
    found = [c for c in range(sys.maxunicode + 1) if c != 0xAD and unicodedata.category(chr(c)) == "Cf"]
    return frozenset(map(chr, found)), dict.fromkeys(found)


def unmarked(text: str) -> str:
    """Text without tags, entities, quote prefixes, invisible characters and broken words; line breaks stay."""
    for _ in range(3):
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    text = _TAG.sub(" ", text) if "<" in text else text
    if not text.isascii() and not _invisible()[0].isdisjoint(text):
        text = text.translate(_invisible()[1])
    text = _BROKEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = text.replace("\u00ad", "")
    return _QUOTE_PREFIX.sub("", text)


def plain_words(text: str) -> list[str]:
    """Lower-case words without accents, markup and look-alike letters; numbers count as words."""
    text = _MARK.sub("", unmarked(text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().translate(_LOOKALIKE_SAFE).replace("ß", "ss")
    return _WORD.findall(_QUOTES.sub("", text.lower()))
