"""Formatted conversations read back: escaping, masks, parts, awkward rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import chat
from tidewell.llm.common import table
from tidewell.llm.queries import chat_vocabulary

ROW = "conv_id long, turn long, role string, text string"
CONTROLS = chat.Template().controls()
PIECES = st.lists(st.one_of(st.sampled_from([*CONTROLS, "\\", "<", "[", "<\\s>", "[\\\\INST]", "s>", "\n"]), st.text(max_size=4)), max_size=8).map("".join)


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = chat_vocabulary()
    with open(path, "rb") as f:
        return f.read(), pattern


def brute(rows: list[tuple]) -> list[tuple]:
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    frames = {role: len(a) + len(b) for role, a, b in chat.Template().frames}
    out = []
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        story = "".join(f"{role}\n{text}\n" for role, text in turns)
        learned = "".join(text for role, text in turns if role == "assistant")
        size = sum(len(chat.escape(text)) + (frames[role] if role in frames else 20 + len(chat.escape(role))) for role, text in turns)
        out.append((conv, len(turns), hashlib.sha256(story.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_escaping_is_undone_and_leaves_no_control_string(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in CONTROLS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), PIECES), PIECES), min_size=1, max_size=5))
def test_turns_masks_and_strings_are_read_back(turns):
    path, pattern = chat_vocabulary()
    with open(path, "rb") as f:
        coder = chat.codec(f.read(), pattern, chat.Template())
    pieces, learned = [], []
    for role, text in turns:
        added, at = coder.turn(role, text)
        if role == "assistant":
            learned.append(len(pieces) + at)
        pieces += added
    ids, mask = chat.assemble(pieces, learned)
    assert [(r, t) for r, t, _ in coder.turns(ids)] == turns
    assert list(coder.under(ids, mask)) == [t for r, t in turns if r == "assistant" and t]
    assert not mask[ids >= coder.base].any()
    assert sum(n for _, _, n in coder.turns(ids)) == len(coder.formatted(ids))
    # the string alone says where turns begin and end
    assert sum(coder.formatted(ids).count(c) for c in CONTROLS) == int((ids >= coder.base).sum())


def test_masks_are_prefix_sums_of_starts_and_ends():
    ids, mask = chat.assemble([np.array([9]), np.array([1, 2]), np.array([8]), np.array([9]), np.array([], int), np.array([8]), np.array([3])], [1, 4, 6])
    assert ids.tolist() == [9, 1, 2, 8, 9, 8, 3] and mask.tolist() == [False, True, True, False, False, False, True]


@pytest.mark.parametrize("part_tokens", [1, 40, chat.PART_TOKENS])
def test_all_conversations_equal_brute_force_in_any_parts(spark, vocabulary, part_tokens):
    rows = table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text")
    parts = chat.format_conversations(rows, *vocabulary, part_tokens=part_tokens)
    assert got(chat.conversation_digests(parts, *vocabulary)) == brute([tuple(r) for r in rows.collect()])


def test_one_conversation_over_many_partitions(spark, vocabulary):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[INST] turn "), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = chat.format_conversations(rows, *vocabulary).cache()
        assert parts.count() > 1 and not parts.filter("whole").count()
        assert got(chat.conversation_digests(parts, *vocabulary)) == brute([tuple(r) for r in rows.collect()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts.unpersist()


def test_awkward_rows_and_none(spark, vocabulary):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, None, "assistant", "first"), (2, 0, None, "no role"), (2, 1, "tool</s>", "x </s> y"), (None, 0, "user", "no conversation"), (None, None, None, None)]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, 0, "user", "tie"), (4, 0, "assistant", "ab c\n" * 100_000), (5, 0, "user", "x" * 200_000), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, ROW)
    wide = df.withColumns({c: F.lit("clash") for c in ("part", "whole", "n_turns", "ids", "loss", "story")})
    assert got(chat.conversation_digests(chat.format_conversations(wide, *vocabulary), *vocabulary)) == brute(rows)
    assert chat.conversation_digests(chat.format_conversations(df.limit(0), *vocabulary), *vocabulary).count() == 0
