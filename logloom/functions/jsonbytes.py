"""JSON at the level of bytes: raw string tokens with paths, validity, top-level timestamps.

Spark's own JSON functions normalise what they read, so raw tokens need a tokenizer. It accepts any bytes from
0x20 inside strings, rejects NaN and the like, and allows repeated keys, each of whose values counts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

SPANS = "struct<status:string,spans:array<struct<path:string,start:int,end:int>>>"

_SPACE = re.compile(rb"[ \t\r\n]*")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"', re.DOTALL)
_ATOM = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")

OK, INVALID = "ok", "invalid"


class _Invalid(Exception):
    pass


def _key(token: bytes) -> str:
    """A key's text with its escapes resolved, as a JSON Pointer segment."""
    import json

    text = token[1:-1].decode("utf-8", "replace") if b"\\" not in token else json.loads(token.decode("utf-8", "replace"))
    return text.replace("~", "~0").replace("/", "~1")


def tokens(data: bytes, at: int = 0):
    """Yield (path, start, end, is_string) of every scalar value in source order; returns where the value ends."""
    stack: list[list] = []  # of [is object, path, next index or key]
    path = ""
    while True:
        at = _SPACE.match(data, at).end()
        first = data[at : at + 1]
        if first in (b"{", b"["):
            stack.append([first == b"{", path, -1])
            at = _SPACE.match(data, at + 1).end()
            if data[at : at + 1] == (b"}" if first == b"{" else b"]"):
                at += 1
                stack.pop()
            else:
                at, path = _next(data, at, stack[-1])
                continue
        elif first == b'"':
            m = _STRING.match(data, at)
            if not m:
                raise _Invalid
            yield path, at, m.end(), True
            at = m.end()
        else:
            m = _ATOM.match(data, at)
            if not m:
                raise _Invalid
            yield path, at, m.end(), False
            at = m.end()
        # after a value: on to the next of its container, or out of it
        while stack:
            at = _SPACE.match(data, at).end()
            mark = data[at : at + 1]
            if mark == b",":
                at, path = _next(data, _SPACE.match(data, at + 1).end(), stack[-1])
                break
            if mark != (b"}" if stack[-1][0] else b"]"):
                raise _Invalid
            at += 1
            stack.pop()
        else:
            return at


def _next(data: bytes, at: int, frame: list) -> tuple[int, str]:
    """The start and path of a container's next value."""
    if not frame[0]:
        frame[2] += 1
        return at, f"{frame[1]}/{frame[2]}"
    m = _STRING.match(data, at)
    if not m:
        raise _Invalid
    at = _SPACE.match(data, m.end()).end()
    if data[at : at + 1] != b":":
        raise _Invalid
    return at + 1, f"{frame[1]}/{_key(m[0])}"


def spans(data: bytes, least: int = 0) -> tuple[str, list[tuple[str, int, int]]]:
    """Status and string tokens of at least ``least`` bytes (quotes counted) of one JSON value; none if it is invalid.

    White space may follow the value; a second value makes it invalid.
    """
    found, scan = [], tokens(data)
    try:
        while True:
            try:
                path, start, end, is_string = next(scan)
            except StopIteration as stop:
                done = _SPACE.match(data, stop.value).end() == len(data)
                return (OK, found) if done else (INVALID, [])
            if is_string and end - start >= least:
                found.append((path, start, end))
    except _Invalid:
        return INVALID, []


def valid(data: bytes) -> bool:
    return spans(data, 1 << 62)[0] == OK


def find_string_spans(least: int = 0):
    """A pandas UDF from string or binary records to SPANS."""

    @F.pandas_udf(SPANS)
    def find(records: pd.Series) -> pd.DataFrame:
        done = [(INVALID, []) if r is None else spans(r.encode() if isinstance(r, str) else bytes(r), least) for r in records]
        return pd.DataFrame({"status": [s for s, _ in done], "spans": [[{"path": p, "start": a, "end": b} for p, a, b in x] for _, x in done]})

    return find


def json_valid():
    """A pandas UDF: whether a string or binary is one JSON value; false for null."""

    @F.pandas_udf("boolean")
    def check(records: pd.Series) -> pd.Series:
        return pd.Series([r is not None and valid(r.encode() if isinstance(r, str) else bytes(r)) for r in records], dtype=bool)

    return check


_PREFIX = re.compile(rb'\s*"timestamp"\s*:\s*("(?:[^"\\]|\\.)*+")')


def top_level_timestamp(data: bytes) -> str | None:
    """The last top-level ``timestamp`` string of a record, read without parsing what stands deeper; null if there is none.

    Brackets and strings are followed byte by byte, so records that don't parse as a whole still give theirs.
    """
    depth, at, found = 0, 0, None
    mark = re.compile(rb'["{}\[\]]')
    while m := mark.search(data, at):
        c, at = m[0], m.end()
        if c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
        else:
            if depth == 1 and (t := _PREFIX.match(data, m.start())):
                found, at = t[1], t.end()
                continue
            s = _STRING.match(data, m.start())
            if not s:
                break
            at = s.end()
    return None if found is None else found[1:-1].decode("utf-8", "replace")


def timestamp_text():
    """A pandas UDF: ``top_level_timestamp`` of string or binary records."""

    @F.pandas_udf("string")
    def read(records: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else top_level_timestamp(r.encode() if isinstance(r, str) else bytes(r)) for r in records], dtype=object)

    return read


def without_ids(text: str, dropped: str) -> str:
    """JSON text without list items and object entries equal to an id, by key or value; numbers keep their spelling."""
    import json

    class Number(str):
        pass

    def clean(v):
        if isinstance(v, list):
            return [clean(x) for x in v if not (type(x) is str and x == dropped)]
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if k != dropped and not (type(x) is str and x == dropped)}
        return v

    def dump(v) -> str:
        if isinstance(v, Number):
            return str.__str__(v)
        if isinstance(v, list):
            return "[" + ",".join(map(dump, v)) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x)}" for k, x in v.items()) + "}"
        return json.dumps(v, ensure_ascii=False)

    return dump(clean(json.loads(text, parse_int=Number, parse_float=Number)))


def remove_id(dropped: str):
    @F.pandas_udf("string")
    def remove(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else without_ids(t, dropped))

    return remove
