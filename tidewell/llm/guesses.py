"""Guess cost of a password: minimum over segmentations, by dynamic programming.

A value is cut into words, dates, repeats, keyboard walks and brute-force spans. Costs are logarithms
(base 10) of the guesses each span takes; a cut into k spans also pays log10(k!) for their order. The
cheapest cut wins. A caller who only asks whether a value is worth ``enough`` bounds the work by it:
what costs that much already is not followed, whatever the length of the value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

#: Common words, most used first; the rank is the number of guesses.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login secret token changeme default "
    "test guest user root example sample demo hello love sunshine princess football baseball shadow michael "
    "superman batman trustno access public private server database system service production staging client "
    "account company office summer winter spring autumn january february march april june july august september "
    "october november december monday friday sunday secure security passphrase correct horse battery staple "
    "apple orange banana cookie coffee computer internet network manager temporary foobar none null true false "
    "your here insert replace enter value string word name this that with from have not the and for are but key api"
).split()


class Ranks(dict):
    """Rank of each word, the first being 1, and the length of the longest."""

    def __init__(self, words: Iterable[str]) -> None:
        super().__init__()
        for w in words:
            self.setdefault(w, len(self) + 1)
        self.longest = max(map(len, self), default=0)


RANKS = Ranks(WORDS)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@831!05$7", "aabeiiosst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
WALK_START, WALK_STEP = math.log10(47.0), math.log10(2.5)


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for dy, dx in ((0, -1), (0, 1), (1, -1), (1, 0), (-1, 0), (-1, 1)):
                if 0 <= y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy]):
                    near.setdefault(key, set()).add(ROWS[y + dy][x + dx])
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEAR = _neighbours()


def alphabet(value: str) -> int:
    """Size of the smallest usual alphabet that holds the value."""
    if re.fullmatch(r"[0-9]*", value):
        return 10
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", value):
        return 16
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value))
    return size + 33 * bool(re.search("[^A-Za-z0-9]", value))


class Spans:
    """Spans that are a word, date, repeat or walk and cost less than ``limit``, asked for from left to right."""

    def __init__(self, value: str, limit: float, ranks: Ranks = RANKS) -> None:
        self.value, self.ranks, self.limit = value, ranks, limit
        low = value.lower()
        self.low = low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        self.plain = self.low.translate(LEET)
        self.base = math.log10(max(alphabet(value), 2))
        self.units = min(int(limit / self.base), len(value) // 2)
        # by unit, 0 for walks: the run looked at last
        self.runs: dict[int, tuple[int, int]] = {}

    def _run_end(self, unit: int, i: int) -> int:
        """End of the run from i in which each character equals the one a unit before, or is its neighbour (unit 0)."""
        step = unit or 1
        start, end = self.runs.get(unit, (0, 0))
        if i < start or i + step > end:
            value, low = self.value, self.low
            end = min(i + step, len(value))
            while end < len(value) and (value[end] == value[end - unit] if unit else low[end] in NEAR.get(low[end - 1], "") or abs(ord(low[end]) - ord(low[end - 1])) == 1):
                end += 1
            self.runs[unit] = (i, end)
        return end

    def at(self, i: int) -> list[tuple[int, float, str]]:
        """(end, cost, kind) of the spans that start at i."""
        value, low, plain, n = self.value, self.low, self.plain, len(self.value)
        found: list[tuple[int, float, str]] = []
        for j in range(i + 3, min(n, i + self.ranks.longest) + 1):
            rank = self.ranks.get(low[i:j])
            leet = rank is None
            rank = rank or self.ranks.get(plain[i:j])
            if rank:
                found.append((j, math.log10(rank + 1) + 0.31 * (value[i:j] != low[i:j]) + 0.6 * leet, "word"))
        for size in (10, 8, 4):
            if i + size <= n and DATE.fullmatch(value, i, i + size):
                found.append((i + size, math.log10(365.0 * 100 if size > 4 else 120) + 0.6 * (size == 10), "date"))
        for unit in range(1, min(self.units, (n - i) // 2) + 1):
            times = (self._run_end(unit, i) - i) // unit
            if times >= 2 and times * unit >= 3:
                found.append((i + times * unit, unit * self.base + math.log10(times), "repeat"))
        end = self._run_end(0, i)
        if end - i >= 3:
            found.append((end, WALK_START + (end - i - 1) * WALK_STEP, "walk"))
        return [f for f in found if f[1] < self.limit]


def spans(value: str, ranks: Ranks = RANKS) -> dict[int, list[tuple[int, float, str]]]:
    """By end: start, cost and kind of each span that is a word, date, repeat or walk, unless brute force is as cheap for all."""
    found: dict[int, list[tuple[int, float, str]]] = {}
    source = Spans(value, len(value) * math.log10(max(alphabet(value), 2)), ranks)
    for i in range(len(value)):
        for end, cost, kind in source.at(i):
            found.setdefault(end, []).append((i, cost, kind))
    return found


def guess_cost(value: str, enough: float | None = None, ranks: Ranks = RANKS) -> float:
    """log10 of the guesses for the cheapest cut of ``value``; 0 for an empty one.

    With ``enough`` the answer is exact below it and ``enough`` otherwise. The state is (position, spans so far, whether the last
    one is brute force). No cut dearer than the limit is followed: that bounds the number of spans (k! grows), the unit of a
    repeat and the reach of brute force, so a costly value ends after a few dozen characters.
    """
    n = len(value)
    if n == 0:
        return 0.0
    per_char = math.log10(max(alphabet(value), 2))
    limit = n * per_char if enough is None else min(enough, n * per_char)
    order = [0.0]
    while len(order) <= n + 1 and order[-1] < limit:
        order.append(math.lgamma(len(order) + 1) / math.log(10))
    most, none = len(order) - 1, math.inf
    source = Spans(value, limit, ranks)
    # cheapest by number of spans: ending in brute force here, or in another span at each position ahead
    brute: list[float] | None = None
    ahead: dict[int, list[float]] = {0: [0.0] + [none] * most}
    for i in range(n):
        other = ahead.pop(i, None)
        if other is None and brute is None:
            if not ahead:
                return limit
            continue
        other, brute = other or [none] * (most + 1), brute or [none] * (most + 1)
        best = [min(a, b) for a, b in zip(other, brute, strict=True)]
        for end, cost, _ in source.at(i):
            for k in range(most):
                c = best[k] + cost
                if c + order[k + 1] < limit:
                    states = ahead.setdefault(end, [none] * (most + 1))
                    states[k + 1] = min(states[k + 1], c)
        longer = [none] + [min(brute[k], other[k - 1]) + per_char for k in range(1, most + 1)]
        longer = [c if c + order[k] < limit else none for k, c in enumerate(longer)]
        brute = longer if min(longer) < none else None
    ends = [s for s in (ahead.get(n), brute) if s]
    return min([limit, *(s[k] + order[k] for s in ends for k in range(1, most + 1))])
