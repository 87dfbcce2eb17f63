"""Pre-tokens of byte-level BPE, found by whole-array operations on code point classes.

Gives the matches of PATTERN: runs of one class; a space goes with the run after it; otherwise the last white space
before a run stands alone; a lone apostrophe takes the contraction's letters after it.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

# Fixed value: the pattern that cuts texts for this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    points = np.arange(0x110000, dtype=np.uint32)
    points = points[(points < 0xD800) | (points > 0xDFFF)]
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = kind
    return table


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pre-tokens of the texts begin; each ends where the next begins (or the texts end)."""
    if not len(data):
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each code point
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[codes]
    n = len(codes)
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(place, offsets)] = True
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= first[:-1]
    at = run.copy()
    begin = np.flatnonzero(run)
    begin = begin[(begin > 0)]
    begin = begin[~first[begin]]
    after_space = begin[(kind[begin] != SPACE) & (kind[begin - 1] == SPACE)]
    blank = codes[after_space - 1] == 0x20
    at[after_space[blank]] = False
    at[after_space - 1] = True
    # contractions: a run of just an apostrophe that starts a pre-token, with the letters that follow
    quote = np.flatnonzero((codes[: n - 1] == 0x27) & at[: n - 1])
    quote = quote[run[quote] & run[quote + 1] & ~first[quote + 1]]
    if len(quote):
        one = codes[quote + 1]
        two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(first[np.minimum(quote + 2, n)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        taken = quote[single | double]
        stop = taken + np.where(single, 2, 3)[single | double]
        at[taken + 1] = False
        at[stop[stop < n]] = True
    return place[at]
