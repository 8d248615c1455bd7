"""Words and windows of UTF-8 bytes as 64-bit hashes, vectorised over a slice of texts."""

from __future__ import annotations

import numpy as np

from tidewell.llm.common import mix

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
#: Powers a worker keeps: those for a slice of 1 MB.
KEPT = (1 << 20) + 1
#: Bytes whose words are hashed at a time; a piece ends between words.
PIECE = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to KEPT of them are kept for the next call."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, KEPT), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) == KEPT:
            _POWERS[int(base)] = held
    return held[:n]


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


class Windows:
    """Hashes of many window lengths over the same values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.total[1:])
        self.back = powers(INVERSE, n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends at each row bound."""
    n = len(mask)
    begin = mask.copy()
    if n:
        begin[1:] &= ~mask[:-1]
        inner = bounds[(bounds > 0) & (bounds < n)]
        begin[inner] = mask[inner]
    starts = np.flatnonzero(begin)
    stop = np.zeros(n + 1, bool)
    stop[1:][mask] = True
    stop[:n][mask & ~begin] = False
    return starts, np.flatnonzero(stop)


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and rows of the words; ``inside`` says by byte value what belongs to a word."""
    starts, ends = runs(inside[data], bounds)
    rows = np.searchsorted(bounds, starts, "right") - 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # a long text in pieces
        at = int(starts[first])
        last = max(int(np.searchsorted(ends, at + PIECE, "right")), first + 1)
        hashes[first:last] = window_hashes(BYTE_CODE[data[at : int(ends[last - 1])]], starts[first:last] - at, ends[first:last] - at)
        first = last
    return starts, ends, hashes, rows
