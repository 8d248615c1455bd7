"""Suffix sorting by the difference cover {1, 2} modulo 3, in numpy.

Suffixes at the sampled places are sorted by their triples; if triples repeat, the sort recurses on the
string of their names. The rest are sorted by first symbol and rank of the next suffix, and merged.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of non-negative integers."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s + 1  # 0 stands for the end
    m = n + (n % 3 == 1)  # with one more sampled place, every place 1 mod 3 has a rank after it
    one, two = np.arange(1, m, 3), np.arange(2, m, 3)
    sample = np.concatenate((one, two))
    names, distinct = _names(t, sample)
    if distinct < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(sample), np.int64)
        order[names] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(sample) + 1)
    if m > n:
        sampled = sampled[sampled < n]
    size = len(sample) + 1
    rest = np.arange(0, n, 3)
    key = t[rest] * size + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    # places of the rest among the sampled suffixes: those 1 mod 3 compare by (t, rank), those 2 mod 3 by (t, t, rank)
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(t[first] * size + rank[first + 1], key)
    wide = int(t.max()) + 1
    if wide * wide < (1 << 62) // size:
        below += np.searchsorted((t[second] * wide + t[second + 1]) * size + rank[second + 2], (t[rest] * wide + t[rest + 1]) * size + rank[rest + 2])
    else:
        pair = np.unique(np.concatenate((t[second] * wide + t[second + 1], t[rest] * wide + t[rest + 1])), return_inverse=True)[1]
        below += np.searchsorted(pair[: len(second)] * size + rank[second + 2], pair[len(second) :] * size + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = below + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def _names(t: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each sampled triple, and how many differ; names keep the order of triples."""
    wide = int(t.max()) + 1
    t = np.append(t, 0)
    if wide < 1 << 20:
        key = (t[sample] * wide + t[sample + 1]) * wide + t[sample + 2]
    else:
        key = np.unique(t[sample] * wide + t[sample + 1], return_inverse=True)[1] * wide + t[sample + 2]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum()) + 1


def repeated_starts(strings: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every ``width``-symbol substring that stands at more than one place.

    The strings are sorted as one text; suffixes with an equal prefix are neighbours in that order.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)  # a 0 ends each string
    for b, x in zip(begin.tolist(), strings):
        text[b : b + len(x)] = x.astype(np.int64) + 1
    ends = np.repeat(begin + sizes, sizes + 1)
    order = suffix_array(text)
    order = order[ends[order] - order >= width]
    left, right = order[:-1], order[1:]
    same = np.zeros(len(left), bool)
    view = text.astype(np.int16) if text.max(initial=0) < 1 << 15 else text
    step = max(1, (8 << 20) // (width * view.itemsize))
    maybe = np.flatnonzero((view[left] == view[right]) & (view[left + width - 1] == view[right + width - 1]) & (view[left + width // 2] == view[right + width // 2]))
    windows = np.lib.stride_tricks.sliding_window_view(view, width) if len(view) >= width else None
    for k in range(0, len(maybe), step):
        p = maybe[k : k + step]
        same[p] = (windows[left[p]] == windows[right[p]]).all(axis=1)
    again = np.zeros(len(order), bool)
    again[:-1] |= same
    again[1:] |= same
    at = np.sort(order[again])
    string = np.searchsorted(begin, at, "right") - 1
    return string, at - begin[string]
