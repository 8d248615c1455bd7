"""Static binary-fuse filters in numpy: three-wise, 8-bit fingerprints, no false negatives."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tidewell.llm.common import mix


@dataclass(frozen=True)
class Fuse:
    seed: int
    segment: int  # length of a segment, a power of two
    starts: int  # slots that a first position can take
    slots: np.ndarray  # uint8

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        where, print_ = _places(keys, self.seed, self.segment, self.starts)
        return (self.slots[where[0]] ^ self.slots[where[1]] ^ self.slots[where[2]]) == print_



def _places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[list[np.ndarray], np.ndarray]:
    h = mix(keys.astype(np.uint64) + np.uint64(seed))
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return [p.astype(np.int64) for p in (first, second, third)], (mix(h) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> Fuse:
    """Filter over distinct 64-bit keys; repeated keys count once, no keys give a filter that holds nothing by chance only."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    count = max(1, -(-room // segment) - 2)
    starts, total = count * segment, (count + 2) * segment
    seed = 0
    while True:
        seed += 0x9E3779B97F4A7C15
        seed &= (1 << 64) - 1
        where, prints = _places(keys, seed, segment, starts)
        order = _peel(where, total, len(keys))
        if order is None:
            total += segment  # a little more room with each failed try
            starts += segment
            continue
        slots = np.zeros(total, np.uint8)
        for at, slot in reversed(order):  # keys of one round own different slots, so a round is one assignment
            a, b, c = (w[at] for w in where)
            slots[slot] = prints[at] ^ slots[a] ^ slots[b] ^ slots[c] ^ slots[slot]
        return Fuse(seed, segment, starts, slots)


def _peel(where: list[np.ndarray], total: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each owns), or None if some keys cannot be set free."""
    degree = np.zeros(total, np.int32)
    owner = np.zeros(total, np.int64)  # xor of the keys at a slot
    for w in where:
        np.add.at(degree, w, 1)
        np.bitwise_xor.at(owner, w, np.arange(n))
    rounds, left = [], n
    ready = np.flatnonzero(degree == 1)
    while left and len(ready):
        keys, first = np.unique(owner[ready], return_index=True)
        slot = ready[first]
        rounds.append((keys, slot))
        left -= len(keys)
        touched = np.concatenate([w[keys] for w in where])
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(owner, touched, np.concatenate([keys] * 3))
        touched = np.unique(touched)
        ready = touched[degree[touched] == 1]
    return None if left else rounds
