"""Out-of-order appends: segments by offset, gaps, overlaps, and the bytes that may be committed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.jsonbytes import valid

MOST_PENDING = 256 << 20


def islands(segments: DataFrame) -> DataFrame:
    """(session_id, island, start, end) of the stretches that segments (session_id, start, end) cover without gap."""
    w = W.partitionBy("session_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = segments.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    s = s.withColumn("island", F.sum("fresh").over(w))
    return s.groupBy("session_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def contiguous_end(segments: DataFrame, committed: DataFrame) -> DataFrame:
    """(session_id, end): how far each session reaches without gap from its ``committed`` size."""
    base = committed.select("session_id", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    all_ = islands(base.unionByName(segments.select("session_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    return all_.where("start = 0").select("session_id", "end")


class GapError(Exception):
    pass


def merge_segments(base: int, pending: list[tuple[int, bytes]], strict: bool = False) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Bytes that follow ``base`` without gap and form whole valid lines, and the segments still pending.

    Overlapping segments must agree byte for byte. A gap waits, or with ``strict`` is an error.
    """
    out, rest = bytearray(), []
    for at, data in sorted(pending):
        end = base + len(out)
        if at > end:
            rest.append((at, data))
            continue
        if at < base:
            data, at = data[base - at :], base
        over = min(end - at, len(data))
        if bytes(out[at - base : at - base + over]) != data[:over]:
            raise GapError(f"segments disagree at offset {at}")
        out += data[over:]
    if rest and strict:
        raise GapError(f"no bytes at offset {base + len(out)}")
    whole = out.rfind(b"\n") + 1
    lines = bytes(out[:whole]).split(b"\n")[:-1]
    good = 0
    for line in lines:
        if not valid(line):
            break
        good += len(line) + 1
    if left := bytes(out[good:]):
        rest.insert(0, (base + good, left))
    if sum(len(d) for _, d in rest) > MOST_PENDING:
        raise GapError("too many bytes wait for a gap to close")
    return bytes(out[:good]), rest


def commit_stream(segments: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """A stream of (session_id string, start long, data binary) to (session_id, start, data) of committed stretches.

    The state of a session is its committed size and its pending segments.
    """

    def commit(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        base, starts, blobs = state.get if state.exists else (0, [], [])
        pending = list(zip(map(int, starts), map(bytes, blobs), strict=True))
        for pdf in batches:
            pending += [(int(a), bytes(d)) for a, d in zip(pdf["start"], pdf["data"], strict=True)]
        done, rest = merge_segments(int(base), pending)
        state.update((int(base) + len(done), [a for a, _ in rest], [d for _, d in rest]))
        if done:
            yield pd.DataFrame({"session_id": [key[0]], "start": [int(base)], "data": [done]})

    return segments.groupBy("session_id").applyInPandasWithState(commit, "session_id string, start long, data binary", "size long, starts array<long>, blobs array<binary>", "append", timeout)
