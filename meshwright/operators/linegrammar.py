"""Problem 3: rows that fail to parse.

A recursive-descent grammar reads delimited text and recovers from errors: after a broken quote it resumes at the next
line start that validates as the start of a record (as many fields as the header, the first of them valid), so one bad
record never swallows the ones behind it. Every record comes out typed, every error with its reason and place, and a text
may give several of both. The search for such a start reads no more fields than a record has, so its time grows with the
text's length times the number of columns. The grammar is

    text    := record (line-break record)*
    record  := field (',' field)*
    field   := blank* (quoted | bare)
    quoted  := '"' (any but '"' | '""')* '"' blank*      followed by ',' or the end of the record
    bare    := any but ',' and line-break

Defined results
---------------
* Null text counts as an empty line: one empty field, so `field_count` unless the header has one column.
* Empty tables give empty results; repeated lines are each returned.
* A line whose file has no header is in error with reason `no_header`.
* A line break outside quotes ends a record: records behind it are typed, and the line has the error `line_break`.
* Records read behind an error in the same line are typed, but the line stays in error.
* Very long lines are read whole. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"
NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_UNSIGNED = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_B = f"[{BLANKS}]*"
LETTERED = re.compile(rf"({_UNSIGNED}){_B}°?{_B}([NSEW])")
SEXAGESIMAL = re.compile(rf"({_UNSIGNED}){_B}°{_B}({_UNSIGNED}){_B}'{_B}({_UNSIGNED}){_B}\"{_B}([NSEW])")
SITE_TYPES = ("POP", "DN", "CN")


@dataclass
class Record:
    """A record as read: its fields as text, where each starts, and the first syntax error with its offset."""

    start: int
    fields: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    error: str | None = None
    error_at: int = 0
    end: int = 0


def _quoted(text: str, at: int, record: Record) -> int:
    """Reads a quoted field from its opening quote mark; returns where the field ended, or -1 after an error."""
    parts, i = [], at + 1
    while True:
        close = text.find('"', i)
        if close < 0:
            record.error, record.error_at = "unclosed_quote", at
            return -1
        parts.append(text[i:close])
        if text.startswith('""', close):
            parts.append('"')
            i = close + 2
            continue
        break
    i = close + 1
    while i < len(text) and (text[i] in BLANKS or text[i] == "\r"):
        i += 1
    if i < len(text) and text[i] not in ",\n":
        record.error, record.error_at = "text_after_quote", i
        return -1
    record.fields.append("".join(parts).strip(BLANKS))
    return i


def _bare(text: str, at: int, line_end: int, record: Record) -> int:
    comma = text.find(",", at, line_end)
    end = line_end if comma < 0 else comma
    record.fields.append(text[at:end].strip(BLANKS + "\r"))
    return end


def read_record(text: str, at: int, most: int | None = None) -> Record:
    """Reads one record that starts at `at`; its end is the offset behind its line break. It is in error beyond `most` fields."""
    record, i = Record(at), at
    line_end = text.find("\n", at)
    line_end = len(text) if line_end < 0 else line_end
    while True:
        if most is not None and len(record.fields) >= most:
            record.error, record.error_at = "field_count", i
            return record
        while i < len(text) and text[i] in BLANKS:
            i += 1
        record.starts.append(i)
        if text.startswith('"', i):
            i = _quoted(text, i, record)
            if i < 0:
                return record
            if i > line_end:
                line_end = text.find("\n", i)
                line_end = len(text) if line_end < 0 else line_end
        else:
            i = _bare(text, i, line_end, record)
        if i < len(text) and text[i] == ",":
            i += 1
            continue
        record.end = i + 1
        return record


def read_text(text: str, anchor, most: int | None = None) -> Iterator[Record]:
    """All records of a text. After a syntax error it resumes at the next line start whose record, of `most` fields, satisfies `anchor`."""
    i, n = 0, len(text)
    while i < n or i == 0:
        record = read_record(text, i)
        if record.error:
            j = text.find("\n", i)
            while j >= 0 and not (j + 1 < n and not (ahead := read_record(text, j + 1, most)).error and anchor(ahead)):
                j = text.find("\n", j + 1)
            record.end = n if j < 0 else j + 1
        yield record
        i = record.end
        if i >= n:
            return


def _number(text: str) -> float | None:
    return float(text) if NUMBER.fullmatch(text) else None


def _whole(text: str) -> int | None:
    x = _number(text)
    return int(x) if x is not None and math.isfinite(x) and x == int(x) and 0 <= x <= 15 else None


def _not_negative(text: str) -> float | None:
    x = _number(text)
    return x if x is not None and x >= 0 else None


def _angle(text: str, letters: str, most: float) -> float | None:
    x = _number(text)
    if x is None:
        if m := LETTERED.fullmatch(text):
            x, letter = float(m[1]), m[2]
        elif m := SEXAGESIMAL.fullmatch(text):
            minutes, seconds, letter = float(m[2]), float(m[3]), m[4]
            if minutes >= 60 or seconds >= 60:
                return None
            x = float(m[1]) + minutes / 60 + seconds / 3600
        else:
            return None
        if letter not in letters:
            return None
        x = -x if letter == letters[1] else x
    return x if -most <= x <= most else None


def _flag(text: str) -> bool | None:
    return {"TRUE": True, "FALSE": False}.get(text.upper())


def _site_type(text: str) -> str | None:
    first = re.split(rf"[{BLANKS}\r\n]+", text, maxsplit=1)[0].upper()
    return first if first in SITE_TYPES else None


_BLANK = object()


def _blank_or(rule):
    return lambda text: _BLANK if not text.strip(BLANKS + "\r\n") else rule(text)


#: Fields of each kind of file with their rules; a rule returns the typed value or None.
KINDS = {
    "mcs": {"mcs": _whole, "snr": _number, "mbps": _not_negative, "tx_backoff": _not_negative},
    "latlon": {
        "base_lon": lambda t: _angle(t, "EW", 180.0), "base_lat": lambda t: _angle(t, "NS", 90.0), "power": _flag, "light": _flag,
        "height": _blank_or(_not_negative), "feet": _blank_or(_not_negative), "type": _site_type, "remarks": lambda t: t,
    },
}
TYPED = {
    "mcs": "bigint", "snr": "double", "mbps": "double", "tx_backoff": "double", "base_lat": "double", "base_lon": "double",
    "power": "boolean", "light": "boolean", "height": "double", "feet": "double", "type": "string", "remarks": "string",
}


def header_fields(kind: str | None, header: str | None) -> list[str | None]:
    """The field each header column stands for; mcs files may append a suffix to the names."""
    if header is None:
        return []
    record = read_record(header.lstrip("\ufeff"), 0)
    names = [x.strip().lower() for x in record.fields]
    if kind == "mcs":
        return [next((f for f in KINDS["mcs"] if n.startswith(f)), None) for n in names]
    return [n if n in KINDS.get(kind or "", {}) else None for n in names]


@dataclass
class Parsed:
    """A record's typed values, or the reason, field and offset (from 1) of its first error."""

    values: dict = field(default_factory=dict)
    reason: str | None = None
    field: str | None = None
    at: int = 0


def _typed(record: Record, columns: list[str | None], rules: dict) -> Parsed:
    if record.error:
        name = columns[len(record.fields)] if len(record.fields) < len(columns) else None
        return Parsed(reason=record.error, field=name, at=record.error_at + 1)
    if len(record.fields) != len(columns):
        return Parsed(reason="field_count", at=record.starts[min(len(columns), len(record.fields)) - 1] + 1)
    values: dict = {}
    for name, value, start in zip(columns, record.fields, record.starts, strict=True):
        if name is None:
            continue
        typed = rules[name](value)
        if typed is None:
            return Parsed(reason="bad_" + name, field=name, at=start + 1)
        if typed is not _BLANK:
            values[name] = typed
    return Parsed(values)


def parse_text(kind: str | None, columns: list[str | None], text: str | None) -> list[Parsed]:
    """All records of a line's text, typed or in error; a break outside quotes is one more error."""
    if not columns:
        return [Parsed(reason="no_header", at=1)]
    rules, text = KINDS.get(kind or "", {}), (text or "").rstrip("\r\n")
    first = next((i for i, c in enumerate(columns) if c is not None), None)
    anchor = lambda r: len(r.fields) == len(columns) and (first is None or rules[columns[first]](r.fields[first]) is not None)
    records = list(read_text(text, anchor, len(columns)))
    out = [_typed(r, columns, rules) for r in records]
    if len(records) > 1 and not records[0].error:
        out.insert(1, Parsed(reason="line_break", at=records[0].end))
    return out


def parse_line(kind: str | None, columns: list[str | None], text: str | None) -> tuple[dict, str | None, str | None, int]:
    """Typed values of a line of one record, or of the line's first error its reason, field and offset (0 without an error)."""
    parsed = parse_text(kind, columns, text)
    bad = next((p for p in parsed if p.reason), None)
    return ({}, bad.reason, bad.field, bad.at) if bad else (parsed[0].values, None, None, 0)


_OUT = "line_id bigint, file_name string, file_kind string, line_no bigint, record_no bigint, " + ", ".join(f"`{k}` {v}" for k, v in TYPED.items())
SCHEMA = _OUT + ", error_reason string, error_field string, error_at bigint, error_no bigint, line_ok boolean, raw_line string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    headers: dict = {}
    for pdf in batches:
        rows = []
        for line_id, name, kind, no, text, header in pdf.itertuples(index=False, name=None):
            kind = None if kind is None else kind.strip().lower()
            columns = headers.get((kind, header))
            if columns is None:
                if len(headers) > 10_000:
                    headers.clear()
                columns = headers[kind, header] = header_fields(kind, header)
            parsed = parse_text(kind, columns, text)
            errors, ok = 0, all(p.reason is None for p in parsed)
            for k, p in enumerate(parsed, 1):
                errors += p.reason is not None
                rows.append((line_id, name, kind, no, k, *(p.values.get(c) for c in TYPED), p.reason, p.field, p.at, errors if p.reason else None, ok, text))
        out = pd.DataFrame(rows, columns=["line_id", "file_name", "file_kind", "line_no", "record_no", *TYPED, "error_reason", "error_field", "error_at", "error_no", "line_ok", "raw_line"])
        yield out.astype({k: "Int64" for k in ("line_id", "line_no", "mcs", "error_no")} | {k: "boolean" for k in ("power", "light")})


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed records and located errors of all lines but headers, each line against the header (line 1) of its file.

    A row is a record (record_no within its line) or an error (error_no); line_ok tells if its line has no error at all.
    """
    lines = lines.select("line_id", "file_name", "file_kind", "line_no", "raw_line")
    first = F.min_by("raw_line", "line_id").alias("header")
    headers = lines.filter("line_no = 1").groupBy("file_name").agg(first)
    body = lines.filter("line_no > 1 or line_no is null")
    return body.join(headers, "file_name", "left").select("line_id", "file_name", "file_kind", "line_no", "raw_line", "header").mapInPandas(_parse, SCHEMA)
