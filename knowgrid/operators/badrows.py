"""Rows that fail to parse: a fast columnar path per block, bisection of failing blocks, strict diagnosis of single records."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowgrid.session import spread

PEOPLE_COLUMNS = ("name", "email", "title", "team", "org", "manager", "topics")
BLOCK_ROWS = 512

_QUOTED = r'"(?:[^"]|"")*"'
_MAILBOX = r'[^@\s,;:<>()\[\]\\"]+@[^@\s.,;:<>()\[\]\\"]+(?:\.[^@\s.,;:<>()\[\]\\"]+)+'
_CONTROL = "[\x00-\x1f\x7f-\x9f�]"


def _record_regex(width: int) -> str:
    """RFC 4180 record of ``width`` fields; a bare field with a line break goes to the strict path."""
    field = rf'(?:{_QUOTED}|[^",\r\n]*)'
    return rf"\A{field}(?:,{field}){{{width - 1}}}\z"


def split_record(line: str) -> list[str] | None:
    """Fields of one record under RFC 4180, or None where the quoting breaks it.

    A quote may only open a field, close it right before a comma or the end, or stand doubled inside it.
    """
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            parts, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                parts.append(line[i:j])
                if line[j + 1 : j + 2] == '"':
                    parts.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != ",":
                return None
            out.append("".join(parts))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


_PY_MAILBOX = re.compile(_MAILBOX)
_PY_CONTROL = re.compile(_CONTROL)


def value_fault(name: str, email: str, manager: str) -> bool:
    """The value rule on trimmed fields: somebody is named, addresses are mailboxes, the name is readable."""
    name, email, manager = name.strip(), email.strip(), manager.strip()
    return (
        not (name or email)
        or any(v != "" and not _PY_MAILBOX.fullmatch(v) for v in (email, manager))
        or (name != "" and (not any(ch.isalpha() for ch in name) or bool(_PY_CONTROL.search(name))))
    )


def diagnose(line: str | None, width: int = len(PEOPLE_COLUMNS)) -> tuple[str | None, list[str]]:
    """Reason (None if sound) and fields of a single record."""
    if line is None:
        return "columns", []
    line = re.sub(r"\r?\n?\Z", "", line)
    fields = split_record(line)
    if fields is None:
        return "quoting", []
    if len(fields) != width:
        return "columns", fields
    return ("value" if value_fault(fields[0], fields[1], fields[5]) else None), fields


def _sound(lines: pa.Array, regex: str) -> bool:
    """Whether every record of the block is of the strict form: one columnar kernel over the block."""
    return not lines.null_count and bool(pc.all(pc.match_substring_regex(lines, regex)).as_py())


def _isolate(lines: pa.Array, regex: str) -> tuple[list[int], list[int]]:
    """Places of sound and of bad records: a block that fails is halved until its bad records stand alone."""
    good, bad, todo = [], [], [(0, len(lines))]
    while todo:
        at, n = todo.pop()
        if n and _sound(lines.slice(at, n), regex):
            good += range(at, at + n)
        elif n > 1:
            todo += [(at + n // 2, n - n // 2), (at, n // 2)]
        elif n:
            bad.append(at)
    return good, bad


def _bulk(lines: pa.Array, names: tuple[str, ...]) -> pa.Table | None:
    """Sound records as columns, in one parse; None if the parser disagrees."""
    text = "\n".join(lines.to_pylist()).encode() + b"\n"
    try:
        got = pacsv.read_csv(
            io.BytesIO(text),
            read_options=pacsv.ReadOptions(column_names=list(names), block_size=len(text) + 1, use_threads=False),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return got if got.num_rows == len(lines) else None


def _faulty(t: pa.Table) -> pa.ChunkedArray:
    """Rows whose values are in doubt, by columnar kernels; the strict rule decides on them."""
    name, email, manager = (pc.utf8_trim_whitespace(t[c]) for c in ("name", "email", "manager"))
    mailbox = rf"\A(?:{_MAILBOX})?\z"
    sound = pc.and_(pc.match_substring_regex(email, mailbox), pc.match_substring_regex(manager, mailbox))
    sound = pc.and_(sound, pc.match_substring_regex(name, r"\A(?:[^\x00-\x1f\x7f-\x{9f}\x{fffd}]*\pL[^\x00-\x1f\x7f-\x{9f}\x{fffd}]*)?\z"))
    return pc.invert(pc.and_(sound, pc.or_(pc.not_equal(name, ""), pc.not_equal(email, ""))))


def parse_block(ids: pa.Array, raw: pa.Array, names: tuple[str, ...] = PEOPLE_COLUMNS) -> list[tuple]:
    """(id, reason, *fields) of each record of a block: sound ones by one bulk parse, isolated ones strictly."""
    lines = pc.replace_substring_regex(raw, r"\r?\n?\z", "")
    good, bad = _isolate(lines, _record_regex(len(names)))
    got = _bulk(lines.take(pa.array(good, pa.int32())), names) if good else None
    if good and got is None:
        good, bad = [], sorted(good + bad)
    out, keys = [], ids.to_pylist()
    if got is not None:
        doubt = _faulty(got).to_pylist()
        for k, row in enumerate(zip(*(got[c].to_pylist() for c in names))):
            reason = "value" if doubt[k] and value_fault(row[0], row[1], row[5]) else None
            out.append((keys[good[k]], reason, *row))
    for at in bad:
        reason, fields = diagnose(raw[at].as_py(), len(names))
        out.append((keys[at], reason, *(fields if reason in (None, "value") else [None] * len(names))))
    return out


def separate_bad_rows(df: DataFrame, key: str = "raw_id", line: str = "raw_line", names: tuple[str, ...] = PEOPLE_COLUMNS) -> DataFrame:
    """Every record of ``df`` as ``key, reason, *names``; reason is NULL for the sound ones.

    Records are parsed in Arrow blocks of ``BLOCK_ROWS``; a block holding a bad record is halved until the
    bad ones stand alone and are diagnosed strictly. A NULL record has no fields: ``columns``. Fields of
    records whose columns can't be told are NULL. Extra columns of ``df`` are not read, so their names can't
    clash; an empty table gives an empty table. No shuffle.
    """
    schema = T.StructType(
        [T.StructField(key, T.LongType()), T.StructField("reason", T.StringType())] + [T.StructField(c, T.StringType()) for c in names]
    )
    out = pa.schema([(key, pa.int64()), ("reason", pa.string())] + [(c, pa.string()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column(0), b.column(1).cast(pa.string())
            for at in range(0, b.num_rows, BLOCK_ROWS):
                rows = parse_block(ids.slice(at, BLOCK_ROWS), raw.slice(at, BLOCK_ROWS), names)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    return spread(df.select(F.col(key).cast("long"), F.col(line).cast("string"))).mapInArrow(run, schema)
