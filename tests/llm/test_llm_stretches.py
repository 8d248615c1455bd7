"""Model spans of personal data do not depend on where the windows' edges fall."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.llm import personal
from tidewell.llm.tagger import Tagger


class Marker(Tagger):
    """Takes all that is no exclamation mark for an email."""

    def emissions(self, codes, mask):
        scores = np.zeros((*codes.shape, self.tags))
        scores[:, :, 3:] = -50.0
        scores[:, :, 2] = np.where(codes == personal._code_table()[ord("!")], -9.0, 9.0)
        scores[:, :, 1] = scores[:, :, 2] - 1
        return scores


@pytest.mark.parametrize("value", ["maria.fernandez-lopez @ mail.example-company.co.uk", "a" * 90 + " @ " + "b" * 150 + ".org"])
def test_spans_of_any_length_at_every_offset(value):
    move = np.zeros((9, 9))
    move[0, 2] = move[1:3, 1] = -50.0
    tagger, table = Marker(9, {"t": move}), personal._code_table()
    texts = ["!" * k + value + "!" * 300 for k in range(130)] + ["!" * 77 + value]
    got = personal.model_spans(tagger, texts, [[] for _ in texts], table)
    assert got == [[(t.index(value), 4, t.index(value) + len(value))] for t in texts]
