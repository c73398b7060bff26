"""Several values packed in one field: a parsing expression grammar with ordered alternatives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# field  <- ws '[' ws (value (ws ',' ws value)*)? ws ']' ws EOF  /  item (delim item)* EOF
# item   <- ws (dquoted / squoted) ws &(delim / EOF)  /  bare
# delim  <- [;,|\t\n\r]  /  blank '/' blank
_DQUOTED = re.compile(r'"((?:[^"\\]|""|\\.)*)"', re.S)
_SQUOTED = re.compile(r"'((?:[^'\\]|''|\\.)*)'", re.S)
_DELIM = re.compile(r"[;,|\t\n\r]|(?<=[  ])/(?=[  ])")
_BLANK = "  ​﻿"
_JSON_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

OK, BAD_QUOTE, BAD_BRACKET = "", "quote", "bracket"


def _restore(body: str, quote: str) -> str:
    """Text of a quoted value: doubled and backslashed quotes stand for one."""
    if "\\" in body:
        body = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _JSON_ESCAPE.get(m[1], m[1]), body, flags=re.S)
    return body.replace(quote * 2, quote)


def _skip(s: str, i: int, chars: str = _BLANK) -> int:
    while i < len(s) and s[i] in chars:
        i += 1
    return i


def _quoted(s: str, i: int) -> tuple[str, int] | None:
    """A quoted value at ``i`` that ends before a delimiter, a closing bracket or the end; else None, to backtrack."""
    rule, quote = (_DQUOTED, '"') if s[i : i + 1] == '"' else (_SQUOTED, "'") if s[i : i + 1] == "'" else (None, "")
    m = rule.match(s, i) if rule else None
    if not m:
        return None
    return _restore(m[1], quote), m.end()


def _bracketed(s: str) -> list[tuple[str, str]] | None:
    """A JSON-like list that spans the whole field; None, to backtrack to the plain list."""
    i, out = _skip(s, 0, _BLANK + "\t\r\n"), []
    if s[i : i + 1] != "[":
        return None
    i = _skip(s, i + 1, _BLANK + "\t\r\n")
    while s[i : i + 1] not in ("]", ""):
        got = _quoted(s, i)
        if got is None:
            j = min((k for k in (s.find(",", i), s.find("]", i)) if k >= 0), default=-1)
            if j < 0:
                return None
            got = (s[i:j], j)
        out.append((got[0], OK))
        i = _skip(s, got[1], _BLANK + "\t\r\n")
        if s[i : i + 1] == ",":
            i = _skip(s, i + 1, _BLANK + "\t\r\n")
        elif s[i : i + 1] != "]":
            return None
    if s[i : i + 1] != "]" or _skip(s, i + 1, _BLANK + "\t\r\n") != len(s):
        return None
    return out


def _items(s: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i <= len(s):
        at, flag = _skip(s, i), OK
        got = _quoted(s, at)
        if got is not None:
            end = _skip(s, got[1])
            d = _DELIM.match(s, end)
            if end == len(s) or d:
                out.append((got[0], OK))
                i = d.end() if d else len(s) + 1
                continue
        if s[at : at + 1] == '"':
            flag = BAD_QUOTE
        d = _DELIM.search(s, i)
        out.append((s[i : d.start() if d else len(s)], flag))
        i = d.end() if d else len(s) + 1
    return out


@lru_cache(maxsize=65536)
def unpack(s: str | None) -> tuple[tuple[int, str, str], ...]:
    """(position, value, flag) of the values in ``s``; empty pieces don't count, the flag tells of a malformed quote or bracket."""
    if s is None:
        return ()
    got = _bracketed(s)
    if got is None:
        got = _items(s)
        if s.lstrip(_BLANK).startswith("[") and got:
            got = [(v, BAD_BRACKET if f == OK else f) for v, f in got]
    kept = [(v.strip(_BLANK + "\t\r\n"), f) for v, f in got]
    return tuple((n, v, f) for n, (v, f) in enumerate(((v, f) for v, f in kept if v), 1))


def unpack_values(df: DataFrame, key: str, field: str, value: str = "topic", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per packed value of ``field``: ``key, *keep, pos, value, error``.

    ``pos`` counts from 1 in the order written, repeats stay, empty pieces don't count. ``error`` is NULL, or
    ``quote`` / ``bracket`` where the parser had to backtrack to the bare text. NULL and blank fields give no row.
    Each field is parsed whole; no shuffle, columns other than those named aren't read.
    """
    types = dict(df.select(key, *keep).dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in (key, *keep)] + ["pos int", f"`{value}` string", "error string"])
    n_keep = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, val, err = [], [], [], []
            for k, s in enumerate(b.column(n_keep).to_pylist()):
                for p, v, f in unpack(s):
                    at.append(k)
                    pos.append(p)
                    val.append(v)
                    err.append(f or None)
            idx = pa.array(at, pa.int32())
            cols = [b.column(i).take(idx) for i in range(n_keep)] + [pa.array(pos, pa.int32()), pa.array(val, pa.string()), pa.array(err, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *keep, "pos", value, "error"])

    return df.select(key, *keep, F.col(field).cast(T.StringType()).alias("_packed")).where("trim(_packed) <> ''").mapInArrow(run, schema)
