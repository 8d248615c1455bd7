"""Which rows of the pipeline's deduplication stages remain where ids are null or repeated."""

from __future__ import annotations

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, lang string, source string, n_chars long"
ONE, SEA, OWN, NONE, SIX = "alpha beta gamma delta one", "the sea and the land were calm", "a text of its own without an id", "copies that have no id at all", "another text under the id six"


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup, corpus_pipeline.simhash_near_dedup])
def test_one_row_of_each_group_stays(spark, stage):
    rows = [(7, ONE), (1, ONE), (None, ONE), (None, OWN), (5, SEA), (5, SEA), (None, SEA), (6, SIX), (6, ONE), (None, NONE), (None, NONE)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], ROW).repartition(3)
    got = stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    want = [(1, ONE), (5, SEA), (6, SIX), (None, OWN), (None, NONE)]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)


def test_both_stages_in_order(spark):
    rows = [(3, SEA), (3, SEA), (3, SEA.replace(" ", "  ")), (None, OWN), (None, SEA), (2, ONE), (2, SIX)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], ROW)
    got = corpus_pipeline.simhash_near_dedup(spark, corpus_pipeline.exact_dedup(spark, docs, SMALL), SMALL).collect()
    assert sorted((str(r["doc_id"]), " ".join(r["text"].split())) for r in got) == sorted([("3", SEA), ("None", OWN), ("2", ONE), ("2", SIX)])
