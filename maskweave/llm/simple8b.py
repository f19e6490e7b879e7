"""Simple-8b: whole numbers packed into 64-bit words, in numpy.

The top four bits of a word are its selector: how many numbers it holds and how wide each is. The first number takes
the lowest bits. A number of more than 60 bits is an escape: its word has selector 0 and its place in a table of
64-bit exceptions. Numbers lie in blocks of fixed length that share no word, so a block is read on its own.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format, by selector: numbers in a word, and the bits of each.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
#: Numbers in a block.
BLOCK = 4096

_LEAST_OVER = np.array([1 << w for w in WIDTHS[1:]], np.uint64)
_COUNTS = np.array(COUNTS, np.int64)


def _needed(values: np.ndarray) -> np.ndarray:
    """For each number the least selector whose width holds it; 16: none."""
    return (np.searchsorted(_LEAST_OVER, values, "right") + 1).astype(np.int8)


_SHORT = _needed(np.arange(1 << 16, dtype=np.uint64))


def _runs(fits: np.ndarray, k: int) -> np.ndarray:
    """For each place with k - 1 more after it, whether it and those all fit."""
    have = 1
    while 2 * have <= k and len(fits) > have:
        fits = fits[:-have] & fits[have:]
        have *= 2
    rest = k - have
    return fits[:-rest] & fits[rest:] if rest and len(fits) > rest else fits[: 0 if rest else None]


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each place, the selector of a word that begins there: the one that holds most numbers of those at hand."""
    n = len(values)
    need = _SHORT[values.astype(np.uint16)] if n and values.max() < 1 << 16 else _needed(values)
    places = np.arange(n)
    left = np.minimum(np.minimum(block - places % block, n - places), COUNTS[1]).astype(np.int8)
    chosen = np.where(need > 15, np.int8(ESCAPE), np.int8(15))
    for s in range(14, 0, -1):  # a word of more numbers, where it fits, takes the place of one of fewer
        k = COUNTS[s]
        if k <= n:
            run = _runs(need <= s, k)
            if run.any():
                chosen[: n - k + 1][run & (left[: n - k + 1] >= k)] = s
    return chosen


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word at which each block begins, exceptions) of unsigned 64-bit numbers."""
    values = np.ascontiguousarray(values, np.uint64)
    chosen = _selectors(values, block)
    step, starts, i, n = _COUNTS[chosen].tolist(), [], 0, len(values)
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    chosen = chosen[starts] if n else chosen
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, 16):
        at = np.flatnonzero(chosen == s)
        if len(at) and WIDTHS[s]:
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            words[at] |= np.bitwise_or.reduce(values[starts[at, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(starts, np.arange(0, n, block)), values[starts[escaped]] if n else values


def decode(words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The numbers of whole blocks' words."""
    chosen = (words >> np.uint64(60)).astype(np.int8)
    ends = np.cumsum(_COUNTS[chosen]) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - _COUNTS[chosen] if len(words) else ends
    for s in range(1, 16):
        at = np.flatnonzero(chosen == s)
        if len(at) and WIDTHS[s]:
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            out[begins[at, None] + np.arange(COUNTS[s])] = (words[at, None] >> shifts) & np.uint64((1 << WIDTHS[s]) - 1)
    at = np.flatnonzero(chosen == ESCAPE)
    if len(at):
        out[begins[at]] = exceptions[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out
