"""Skew-safe order: slices stay small whatever the order columns hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import graph as gr
from tidewell.operators.gates import embeddings
from tidewell.operators.mutations import erase
from tidewell.operators.ordered import running_totals, sequenced, series_summary, split_hot


def moments(kind):
    if kind == "one timestamp":
        return [(1, "2024-01-01", k) for k in range(1000)]
    if kind == "one outlier":
        return [(1, "1970-01-01", 0)] + [(1, f"2024-01-01 00:{k % 60:02d}:{k // 60:02d}", k) for k in range(1, 1000)]
    return [(1, f"{k % 7}_S{k}", k) for k in range(1000)]  # text order


@pytest.mark.parametrize("kind", ["one timestamp", "one outlier", "text"])
def test_slices_of_a_heavy_key_stay_small(spark, kind):
    rows = moments(kind) + [(2, "2024-01-01", k) for k in range(5)]
    df = spark.createDataFrame(rows, "user_id int, ts string, id int")
    if kind != "text":
        df = df.withColumn("ts", F.to_timestamp("ts"))
    sizes = split_hot(df, ["user_id"], ["ts", "id"], 50).groupBy("user_id", "_slice").count().collect()
    assert max(r["count"] for r in sizes if r["user_id"] == 1) <= 100
    assert {r["_slice"] for r in sizes if r["user_id"] == 2} == {0}
    plain, cut = (sequenced(df, ["user_id"], ["ts", "id"], {"before": "id"}, total="n", slice_rows=n) for n in (10_000, 50))
    assert sorted(map(tuple, plain.select(sorted(plain.columns)).collect()), key=str) == sorted(map(tuple, cut.select(sorted(cut.columns)).collect()), key=str)


def test_running_totals_with_an_outlier(spark):
    counts = spark.createDataFrame([(float(k), 1) for k in range(1000)] + [(1e15, 1)], "x double, n int")
    got = {r["x"]: r["n_before"] for r in running_totals(counts, "x", ["n"], slice_rows=40).collect()}
    assert got == {float(k): k for k in range(1000)} | {1e15: 1000}


def test_series_summary_of_one_timestamp(spark):
    df = spark.createDataFrame([(1, "2024-01-01", k, (k * 37 % 101) / 101) for k in range(600)], "user_id int, ts string, id int, risk double").withColumn("ts", F.to_timestamp("ts"))
    plain, cut = (series_summary(df, slice_rows=n).first().asDict() for n in (10_000, 40))
    for name, value in plain.items():
        assert cut[name] == pytest.approx(value) if isinstance(value, float) else cut[name] == value, name


def test_erase_reaches_a_deep_chain_and_a_cycle(spark):
    edges = [(f"x{k}", f"x{k + 1}", "r") for k in range(40)] + [("x40", "c0", "r"), ("c0", "c1", "r"), ("c1", "c0", "r"), ("other", "x3", "r"), ("other", "free", "r")]
    nodes = [(n,) for n in sorted({e[0] for e in edges} | {e[1] for e in edges})]
    node, edge = spark.createDataFrame(nodes, "node_id string"), spark.createDataFrame(edges, "src string, dst string, rel_type string")
    left, links = erase(node, edge, spark.createDataFrame([("x0",)], "root string"))
    assert {r[0] for r in left.collect()} == {"other", "free"}
    assert [tuple(r) for r in links.collect()] == [("other", "free", "r")]


def test_levels_of_a_long_chain_a_dag_and_a_cycle(spark):
    chain = [(f"s{k}", f"s{k + 1}") for k in range(1000)]
    dag = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("z", "d")]
    frame = lambda pairs: spark.createDataFrame([(*p, "TEMPORALLY_PRECEDES") for p in pairs], "src string, dst string, rel_type string")
    got = {r["node_id"]: r["level"] for r in gr.ancestors(frame(chain + dag)).collect()}
    assert got == {f"s{k}": k for k in range(1001)} | {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}
    for cycle in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "b"), ("z", "c")]):
        with pytest.raises(ValueError):
            gr.ancestors(frame(cycle))


def test_repeated_vectors_of_one_participant_are_reported(spark):
    rows = [("p1", [1.0, 2.0], "v1")] * 3 + [("p2", [1.0, 2.0], "v1"), ("p3", [3.0], "v1"), ("p4", [3.0], "v1")]
    issues = embeddings(spark.createDataFrame(rows, "participant_id string, v array<double>, model_version string")).collect()
    assert sorted(r["participant_id"] for r in issues) == ["p1", "p1", "p2", "p4"]
