"""Stages keep columns that are named like their own, and columns of any type."""

from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_clashing_columns_and_maps(spark):
    text = "the sea and the land and the wind over the hills"
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, "le vent et la mer sont dans la nuit", "fr", "b", 2), (None, "12", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"_key": F.lit("mine"), "_key_": F.lit("too"), "_row": F.lit("other"), "held_out": F.lit(5), "meta": F.create_map(F.lit("a"), F.lit(1))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.dtypes == docs.dtypes, name
        found = kept.collect()
        assert all((r["_key"], r["_key_"], r["_row"], r["held_out"], r["meta"]) == ("mine", "too", "other", 5, {"a": 1}) for r in found), name
        if name == "exact_dedup":
            assert sorted(r["doc_id"] or 0 for r in found) == [0, 1, 3]
