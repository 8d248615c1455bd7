"""Emails equal the plain pattern, in time linear in the text."""

import random
import re
import time

from tidewell.llm.personal import emails

PLAIN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_equal_the_pattern():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-_ %é") for _ in range(rng.randrange(40)))
        assert emails(text) == [m.span() for m in PLAIN.finditer(text)], text
    for run in (63, 64, 65, 255, 256, 257, 5000):
        text = "é" + "a" * run + "@b.de " + "@" * 3 + "a" * run + "@c.d"
        assert emails(text) == [m.span() for m in PLAIN.finditer(text)]


def test_very_long_texts():
    start = time.time()
    assert emails("a @ " * 1_000_000) == []
    assert emails("a" * 3_000_000 + "@b.de") == [(0, 3_000_005)]
    assert time.time() - start < 20
