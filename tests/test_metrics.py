"""Small literal cases of vector, text, dataset and evaluation operators."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import quality as ql
from tidewell.functions import text as tx
from tidewell.functions import vectors as vx
from tidewell.operators import dataset as ds
from tidewell.operators import evaluation as ev
from tidewell.operators import gates as gt
from tidewell.operators import graph as gr
from tidewell.operators import mutations as mu
from tidewell.operators import vectorsets as vs


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_similarity(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    r = one(spark, j=vx.jaccard(a, b), empty=vx.jaccard(none, none), s=vx.session_similarity(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x")), a, a),
            zero=vx.cosine(F.expr("array(0D, 0D)"), F.expr("array(1D, 2D)")), short=vx.cosine(F.expr("array(1D)"), F.expr("array(1D, 2D)")))
    assert math.isclose(r["j"], 1 / 3) and r["empty"] == 1.0 and r["s"] == 0.75 and r["zero"] == 0.0 and r["short"] == 0.0


def test_quality_scores(spark):
    sync = one(spark, s=ql.sync_score(F.lit(100.0), F.lit(500), F.lit(0)))
    assert sync["s"] == 0.6
    df = spark.createDataFrame([("300", "300", True, False, True, 0.85, 0.9)], "participant_id STRING, session_id STRING, has_audio BOOLEAN, has_visual BOOLEAN, has_transcript BOOLEAN, quality_score DOUBLE, sync_score DOUBLE")
    row = gt.quality_scores(df).first()
    assert row["overall"] == 0.695 and row["category"] == "acceptable"


def test_moments_match_bias_corrected_forms(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 5, 9, 10)], "x DOUBLE")
    row = ds.numeric_profile(df, ["x"]).first()
    assert round(row["skewness"], 4) == 0.1231 and round(row["kurtosis"], 4) == -2.7111
    assert (row["median"], row["q25"], row["q75"]) == (5.0, 2.0, 9.0)


def test_graph_density_and_importance(spark):
    node = spark.createDataFrame([("a", "Session"), ("b", "Session"), ("c", "User")], "node_id STRING, label STRING")
    edge = spark.createDataFrame([("a", "b", "FOLLOWED_BY"), ("b", "c", "X"), ("a", "c", "X"), ("c", "a", "X")], "src STRING, dst STRING, rel_type STRING")
    row = gr.summary(node, edge).first()
    assert round(row["density"], 4) == 1.3333 and row["temporal_density"] == 1.0
    degrees = spark.createDataFrame([("u1", 5), ("u2", 2)], "node_id STRING, degree BIGINT")
    assert gr.importance(degrees).orderBy(F.desc("importance")).first()["importance"] == 2.5


def test_text_rules(spark):
    text = F.lit("I feel saaaaaaad and ''lonely''!  We went down. No?")
    r = one(spark, c=tx.clean(text), s=tx.sentences(F.lit("One. Two!  Three")), top=tx.top_entry(tx.emotions(F.lit("alone and isolated"))), calm=tx.emotions(F.lit("xyz"))["neutral"],
            kw=tx.keyword_hits(F.lit("Download the pressure")), wide=tx.clean(F.lit("Ａ\u0000b")))
    assert r["c"] == "I feel saaad and 'lonely'! We went down. No?"
    assert r["s"] == ["One.", "Two!", "Three"] and r["top"] == "loneliness" and r["calm"] == 1.0
    assert r["kw"] == {"depression": ["down"], "stress": ["pressure"]} and r["wide"] == "Ab"


def test_classifier_metrics(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 1, 0.6), (1, 1, 0.6), (-1, 1, 0.1)]
    df = spark.createDataFrame(rows, "label BIGINT, pred BIGINT, score DOUBLE")
    m = ev.classification(df).first()
    assert (m["support"], m["accuracy"]) == (5.0, 0.6) and math.isclose(m["f1"], 2 / 3)
    # pairs (pos, neg): 0.9>0.2 0.9>0.6 0.4>0.2 0.4<0.6 0.6>0.2 0.6=0.6 -> 4.5 of 6
    assert math.isclose(ev.roc_auc(df, slice_rows=1).first()["roc_auc"], 0.75)
    assert ev.confusion(df).count() == 4
    assert ev.classification(df.filter("label = 9")).first()["support"] == 0.0


def test_t_tail_values():
    assert math.isclose(ev.t_tail(0.0, 5), 1.0)
    assert math.isclose(ev.t_tail(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(ev.t_tail(12.706204736, 1), 0.05, rel_tol=1e-6)


def test_gates_and_flags(spark):
    sessions = spark.createDataFrame([("1", "1", "d", "train", "normal"), ("1", "1", "d", "dev", "odd")], "participant_id STRING, session_id STRING, dataset STRING, split STRING, label STRING")
    index = spark.createDataFrame([("a",), ("a",)], "file_path STRING")
    issues = gt.union([gt.consistency(sessions), gt.leakage(sessions, index)])
    gates = {r["gate"]: r["status"] for r in gt.roll_up(issues).collect()}
    assert gates == {"consistency": "failed", "leakage": "failed"}
    assert not gt.approval(gt.roll_up(issues)).first()["approved"]
    assert {r["check"] for r in gt.consistency(sessions.drop("label")).collect()} == {"metadata", "duplicate_session"}


def test_guards(spark):
    with pytest.raises(PermissionError):
        vs.pair_similarity(spark.range(1), spark.range(1))
    with pytest.raises(ValueError):
        gr.neighbourhood(spark.range(1), spark.range(1), hops=9)
    with pytest.raises(ValueError):
        mu.backup_manifest(spark.createDataFrame([(1,)], "media_bytes INT"), spark.range(1))


def test_upsert_keeps_absent_values(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k INT, p STRING, q STRING")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k INT, p STRING")
    assert sorted(map(tuple, mu.upsert(old, new, "k").collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]


def test_oversampling_and_folds(spark):
    df = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(300)], "id BIGINT, label INT")
    counts = {r["label"]: r["count"] for r in ds.stratified_oversample(df, "label", "id").groupBy("label").count().collect()}
    assert counts == {0: 270, 1: 270}
    folds = ds.kfold(df, "id").groupBy("fold").count().collect()
    assert len(folds) == 5 and sum(r["count"] for r in folds) == 300


def test_plain_texts_are_not_sent_to_python(spark, monkeypatch):
    def only_other(texts: pd.Series) -> pd.Series:
        assert not any(t.isascii() for t in texts if t is not None)
        return texts.str.normalize("NFKC")

    monkeypatch.setattr(tx, "_nfkc", only_other)
    rows = spark.createDataFrame([(1, "plain"), (2, "Ａb"), (3, None), (4, "")], "i INT, t STRING")
    assert {r["i"]: r["c"] for r in rows.select("i", tx.compose(F.col("t")).alias("c")).collect()} == {1: "plain", 2: "Ab", 3: None, 4: ""}
