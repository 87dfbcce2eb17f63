"""Texts of Arrow batches as byte arrays, and their words, by whole-array operations."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a scan holds at a time (one longer text is a step of its own).
STEP_BYTES = 1 << 20

# Space and U+0009 to U+000D, the characters between words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of successive runs of rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, stop, bytes_[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def return_memory() -> None:
    """Give freed memory back to the system.

    Python workers outlive their tasks and share their executor's memory with the JVM, so what one has freed
    but keeps for itself is missing elsewhere. Scans call this where they begin and end.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the index of each text's first word (one more at the end)."""
    inside = in_word[data]
    cut = offsets[1:-1]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[cut[cut < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RANDOM = np.random.default_rng(20250101)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Fixed values of the splitmix64 finaliser, and an odd base with its inverse modulo 2 ** 64.
_MIX_1, _MIX_2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        found.append(np.cumprod(factors, dtype=np.uint64))
    return found[0], found[1]


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(STEP_BYTES + 1) if len(data) <= STEP_BYTES else _powers.__wrapped__(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * _GOLDEN)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running sum of byte values times powers, moved to position 0.

    Words come in order. A long text is done in pieces, so that only a word longer than a step needs more memory.
    """
    if len(data) <= STEP_BYTES:
        return _piece_hashes(data, starts, ends)
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + STEP_BYTES, "right")))
        found.append(_piece_hashes(data[low : ends[stop - 1]], starts[at:stop] - low, ends[at:stop] - low))
        at = stop
    return np.concatenate(found)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, sorted and distinct within it; and each text's first index.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    n_words = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    factors = mixed(_GOLDEN * np.arange(1, width + 1, dtype=np.uint64))
    for k in range(width):
        if n > k:
            rolled[: n - k] += mixed(hashes[k:] ^ factors[k])  # one more mixing for each place, so order counts
    rolled = mixed(rolled + np.uint64(width))
    keep = np.ones(n, bool)
    for k in range(1, width):  # the last width - 1 words of a text start no shingle
        at = first[1:] - k
        keep[at[(at >= first[:-1])]] = False
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    for i in short:
        own = hashes[first[i] : first[i + 1]]
        with np.errstate(over="ignore"):
            rolled[first[i]] = mixed(np.sum(mixed(own ^ factors[: len(own)]), dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
        keep[first[i]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    rolled, at = rolled[keep], sums[first]
    for i in range(len(at) - 1):
        rolled[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = rolled[1:] != rolled[:-1]
    fresh[at[:-1][at[:-1] < len(rolled)]] = True
    return rolled[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]
