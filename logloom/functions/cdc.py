"""Content-defined chunking with a rolling gear hash, by whole-array operations.

The hash is g = 2 g + T[byte], so its low k bits depend on the last k bytes alone: every position's bits can be
had at once, and cutting is a walk over the positions whose bits are all zero.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

CHUNKS = "array<struct<start:long,end:long,digest:string>>"
# The seed of the gear table, and splitmix64's constants.
SEED, STEP, MIX_1, MIX_2 = 0x6A09E667F3BCC909, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Bounds(NamedTuple):
    least: int = 64 << 10
    average: int = 256 << 10
    most: int = 1 << 20

    def checked(self) -> Bounds:
        if not 0 < self.least <= self.average <= self.most:
            raise ValueError("chunk bounds must be ordered: least, average, most")
        if self.average & (self.average - 1):
            raise ValueError("the average chunk size must be a power of two")
        return self


def gear_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.uint64(SEED) + np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
        return x ^ (x >> np.uint64(31))


GEAR = gear_table()


def cuts(data: bytes, bounds: Bounds) -> list[int]:
    """Where the chunks of ``data`` end."""
    least, average, most = bounds
    n, bits = len(data), average.bit_length() - 1
    if not n:
        return []
    if least < bits:
        return _walked(data, bounds)
    low = (GEAR & np.uint64(average - 1))[np.frombuffer(data, np.uint8)]
    g = np.zeros(n, np.uint64)
    for back in range(min(bits, n)):
        g[back:] += low[: n - back] << np.uint64(back)
    zero = np.flatnonzero((g & np.uint64(average - 1)) == 0)
    ends, start = [], 0
    while start < n:
        i = np.searchsorted(zero, start + least - 1)
        end = min(int(zero[i]) + 1 if i < len(zero) else n, start + most, n)
        ends.append(end)
        start = end
    return ends


def _walked(data: bytes, bounds: Bounds) -> list[int]:
    """The same by following the hash, for chunks shorter than its window."""
    mask, table = bounds.average - 1, [int(x) for x in GEAR]
    ends, g, start = [], 0, 0
    for i, byte in enumerate(data, 1):
        g = (2 * g + table[byte]) & mask
        if i - start >= bounds.most or (i - start >= bounds.least and not g):
            ends.append(i)
            g, start = 0, i
    return ends if start == len(data) else [*ends, len(data)]


def chunks(data: bytes, bounds: Bounds) -> list[tuple[int, int, str]]:
    ends = cuts(data, bounds)
    return [(a, b, hashlib.sha256(data[a:b]).hexdigest()) for a, b in zip([0, *ends], ends, strict=False)]


def cdc_chunks(bounds: Bounds = Bounds()):
    """A pandas UDF from whole files (string or binary) to CHUNKS."""
    bounds.checked()

    @F.pandas_udf(CHUNKS)
    def cut(files: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else [{"start": a, "end": b, "digest": d} for a, b, d in chunks(f.encode() if isinstance(f, str) else bytes(f), bounds)] for f in files], dtype=object)

    return cut
