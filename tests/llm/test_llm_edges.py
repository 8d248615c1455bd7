"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import language, personal
from tidewell.llm.bpe import encode_documents
from tidewell.llm.common import table
from tidewell.llm.decontaminate import contamination
from tidewell.llm.exact import exact_duplicates
from tidewell.llm.passages import substring_dedup
from tidewell.llm.quality import quality_scores
from tidewell.llm.queries import vocabulary_path
from tidewell.llm.secrets import scan_secrets
from tidewell.llm.simhash import near_duplicates
from tidewell.llm.substrings import byte_dedup

SMALL = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named as the operators' own.
CLASHES = ["key", "a", "s", "lo", "hi", "fp", "norm", "digest", "keep_id", "n", "bucket", "held_out", "score", "ranges", "_n", "_item", "pool", "windows", "root", "component_id"]

OPERATORS = {
    "exact": lambda s, d: exact_duplicates(d),
    "secrets": lambda s, d: scan_secrets(d),
    "bytes": lambda s, d: byte_dedup(d),
    "personal": lambda s, d: personal.scan_personal(d, personal.learn(d)),
    "quality": lambda s, d: quality_scores(d, table(s, SMALL, "labels")),
    "contamination": lambda s, d: contamination(d, table(s, SMALL, "benchmark")),
    "bpe": lambda s, d: encode_documents(d, vocabulary_path()),
    "simhash": lambda s, d: near_duplicates(d),
    "words": lambda s, d: substring_dedup(d),
    "language": lambda s, d: language.identify(d, language.learn(d)),
}


def awkward(spark):
    long = " ".join(f"word{k % 977} the sea" for k in range(40_000))
    rows = [(1, long, "en", "a", 1), (2, None, None, None, None), (3, "", "fr", "a", 0), (4, " \n\t ", "fr", "b", 4), (5, "the sea and the land", "en", None, 3), (5, "the sea and the land", "en", None, 3)]
    rows += [(None, "the sea and the land", None, "x", 2), (None, None, None, None, None), (6, "mail a@b.de 4111 1111 1111 1111", "de", "a", None), (7, "x" * 200_000, "de", "a", None)]
    docs = spark.createDataFrame(rows, ROW)
    return docs.withColumns({c: F.lit("other") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_awkward_rows_and_on_none(spark, name):
    docs = awkward(spark)
    got = OPERATORS[name](spark, docs).select("doc_id").collect()
    want = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in got)
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_pipeline_stages_on_awkward_rows_and_on_none(spark):
    plain = awkward(spark).drop(*CLASHES)
    for docs in (plain, plain.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SMALL)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_undetermined_language_and_defined_nulls(spark):
    docs = awkward(spark)
    by = {}
    for r in language.identify(docs, language.learn(docs)).collect():
        by.setdefault(r["doc_id"], r)
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[2]["score"] == 0
    exact = [r for r in exact_duplicates(docs).collect() if r["group_size"] == 3 and r["keep_id"] == 5]
    assert sorted(str(r["kept"]) for r in exact) in (["None", "True", "True"], ["False", "True", "True"])
