"""Language identification where the labelled languages have more letters together than one small alphabet."""

from __future__ import annotations

import random

import pytest

from tidewell.llm import language

#: First letter and number of letters; two of them lie beyond the basic plane.
SCRIPTS = {"cs": (0x4E00, 900), "ct": (0x5E00, 900), "ko": (0xAC00, 900), "ru": (0x0430, 32), "xa": (0x20000, 300), "xb": (0x21000, 300)}


def words(rng, low, count, n):
    return " ".join("".join(chr(low + rng.randrange(count)) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.mark.parametrize("dense", [language.DENSE, 0])
def test_languages_of_many_scripts(monkeypatch, dense):
    monkeypatch.setattr(language, "DENSE", dense)
    rng = random.Random(12)
    sample = {name: [words(rng, *script, 1500)] for name, script in SCRIPTS.items()} | {"en": ["the sea and the land were calm " * 2000]}
    model = language.model_of(sample)
    texts = {name: words(rng, *script, 60) for name, script in SCRIPTS.items()} | {"en": "the land and the sea"}
    best, _, bits = language.judge(model, list(texts.values()), language.code_table(model.letters))
    assert best == list(texts)
    assert dense or all(a.table is None for a in model.automata)
    strange, _, high = language.judge(model, ["ሀሁሂሃ " * 20], language.code_table(model.letters))
    assert high[0] > max(bits)
