"""Putting interrupted JSON records together again, session by session.

A record that another one broke into stays open; what follows is appended to the innermost open record until it is
whole. The outer record comes before what interrupted it. Sessions repair in parallel; one session is a stateful fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsonbytes import _Invalid, tokens, valid

# How an interrupted record begins, and a complete one inside a fragment.
BEGIN = re.compile(rb'\{"timestamp"\s*:')
WHOLE = re.compile(rb'\{\s*"timestamp"\s*:')
MOST_BUFFERED = 64 << 20


class RepairError(Exception):
    pass


class Repaired(NamedTuple):
    records: list[bytes]
    orphans: list[bytes]
    invalid_lines: int
    reconstructed: int


def conversation_kind(record: bytes) -> str:
    import json

    try:
        r = json.loads(record)
    except ValueError:
        return ""
    if not isinstance(r, dict) or "timestamp" not in r or not isinstance(p := r.get("payload"), dict):
        return ""
    if r.get("type") == "response_item" and p.get("type") == "message" and p.get("role") in ("user", "assistant"):
        return f"response_item:{p['role']}"
    return f"event_msg:{p['type']}" if r.get("type") == "event_msg" and p.get("type") in ("user_message", "agent_message") else ""


def has_conversation(fragment: bytes) -> bool:
    """Whether a complete user or assistant record stands somewhere in a fragment."""
    for m in WHOLE.finditer(fragment):
        scan = tokens(fragment, m.start())
        try:
            while True:
                next(scan)
        except StopIteration as stop:
            if conversation_kind(fragment[m.start() : stop.value]):
                return True
        except _Invalid:
            pass
    return False


def repair(data: bytes, allow_orphans: bool = False) -> Repaired:
    """The records of ``data`` made whole, in order. Without ``allow_orphans`` a fragment of no record is an error.

    Complete user or assistant records are never given up as orphans, and come out as they went in.
    """
    out: list[bytes] = []
    orphans: list[bytes] = []
    open_: list[tuple[bytearray, list[bytes]]] = []  # an open record's bytes, and the whole records that came meanwhile
    invalid = reconstructed = 0

    def orphan(fragment: bytes) -> None:
        if not fragment.strip():
            return
        if not allow_orphans:
            raise RepairError("a fragment belongs to no interrupted record")
        if has_conversation(fragment):
            raise RepairError("a complete conversation record would be lost")
        orphans.append(fragment)

    def append(fragment: bytes) -> None:
        nonlocal reconstructed
        if not open_:
            orphan(fragment)
            return
        partial, waiting = open_[-1]
        partial += fragment
        if sum(len(p) + sum(map(len, w)) for p, w in open_) > MOST_BUFFERED:
            raise RepairError("an interrupted record is too large")
        if valid(bytes(partial)):
            open_.pop()
            reconstructed += 1
            (open_[-1][1] if open_ else out).extend([bytes(partial), *waiting])

    lines = data.split(b"\n")
    for line in lines if lines[-1] else lines[:-1]:
        line = line.removesuffix(b"\r")
        if valid(line):
            (open_[-1][1] if open_ else out).append(line)
            continue
        invalid += 1
        begins = [m.start() for m in BEGIN.finditer(line)]
        at = 0
        for begin in begins:
            if begin > at:
                append(line[at:begin])
            open_.append((bytearray(), []))
            at = begin
        append(line[at:])
    if open_ and not allow_orphans:
        raise RepairError("an interrupted record is never completed")
    for partial, waiting in open_:
        orphan(bytes(partial))
        out += waiting
    return Repaired(out, orphans, invalid, reconstructed)


def repaired(sessions: DataFrame, session: str, data: str, allow_orphans: bool = False) -> DataFrame:
    """(session_id, kind, idx, record, invalid_lines, reconstructed): kind is record, orphan, or error (record says which)."""
    rows = sessions.select(F.col(session).alias("session_id"), F.col(data).cast("binary").alias("data"))
    id_type = rows.schema["session_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, blob in zip(batch["session_id"], batch["data"], strict=True):
                try:
                    done = repair(blob.as_py() or b"", allow_orphans)
                    found = [("record", i, r) for i, r in enumerate(done.records)] + [("orphan", i, r) for i, r in enumerate(done.orphans)]
                    counts = (done.invalid_lines, done.reconstructed)
                except RepairError as e:
                    found, counts = [("error", 0, str(e).encode())], (0, 0)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid.as_py()] * n, batch.schema.field("session_id").type), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary()), pa.array([counts[0]] * n, pa.int64()), pa.array([counts[1]] * n, pa.int64())],
                    names=["session_id", "kind", "idx", "record", "invalid_lines", "reconstructed"],
                )

    return rows.mapInArrow(fold, f"session_id {id_type}, kind string, idx long, record binary, invalid_lines long, reconstructed long")
