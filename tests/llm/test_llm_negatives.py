"""Hard negatives against brute force, with every switch of the pruning forced, and awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.negatives import Bucket, hard_negatives

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], every: int = 50, positives: int = 5, negatives: int = 3) -> list[tuple]:
    good = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        good.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for i, v, label in good:
        if i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, own) for j, w, own in good if len(w) == len(v)]
        near = sorted(((-s, j) for s, j, own in score if own == label and j != i))[:positives]
        for s, j in near:
            far = sorted((-n, k) for n, k, own in score if own != label and 50 * -s <= 100 * n <= 95 * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(far)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def vectors(n: int, size: int, seed: int, spread: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    label = rng.integers(0, 6, n)
    x = centres[label] + spread * rng.normal(size=(n, size))
    x *= rng.lognormal(0, 0.6, n)[:, None] / math.sqrt(size)
    return [(k, [float(np.float32(c)) for c in v], int(a)) for k, (v, a) in enumerate(zip(x, label))]


@pytest.mark.parametrize("size,spread,focus", [(8, 0.3, 3), (16, 1.0, 1), (3, 0.5, 3), (1, 1.0, 3)])
def test_equals_brute_force_in_small_buckets_and_blocks(spark, size, spread, focus):
    rows = vectors(700, size, size, spread)
    df = spark.createDataFrame(rows, ROW)
    found = hard_negatives(df, F.col("vec_id") % 50 == 0, bucket_rows=37, range_rows=150, anchors_at_a_time=5, focus=focus)
    assert got(found) == brute(rows)


def test_ranges_of_focus_coordinates_lose_nothing_and_leave_rows_out():
    rows = vectors(2000, 8, 5, 0.3)
    v = np.array([[math.floor(256 * c / math.hypot(*x)) for c in x] for _, x, _ in rows[:500]], np.int32)  # of about one length
    bucket = Bucket(np.arange(500), np.zeros(500, np.int64), v)
    kept = 0
    for anchor in v[::25]:
        score = v.astype(np.int64) @ anchor.astype(np.int64)
        length = math.sqrt(float(anchor.astype(float) @ anchor))
        unit = anchor / length
        for least in (int(np.sort(score)[-5]), int(np.median(score)), 1, 0, -1, int(score.min())):
            rows_ = bucket.candidates(unit, length, np.argsort(-np.abs(unit))[:3], least)
            want = set(np.flatnonzero(score >= least).tolist())
            assert rows_ is None or want <= set(rows_.tolist())
            kept += rows_ is not None and len(rows_) < 250 and least == int(np.sort(score)[-5])
    assert kept > 10


def test_awkward_rows_ties_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.5 + (k % 3) / 10], k % 2) for k in range(0, 120)]  # many ties
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [nan, 1.0], 0), (203, [inf, 1.0], 0), (204, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (250, [0.0, 0.0], 1), (251, [0.0, 0.0], 0), (252, [-1.0, -1.0], 0)]
    rows += [(300, [1.0], 0), (301, [1.0], 0), (302, [0.8], 1), (350, [], 0), (351, [], 0), (352, [], 1), (400, [-1.0, 0.1], 1), (401, [3e38, 1.0], 1)]
    df = spark.createDataFrame(rows, ROW)
    want = brute([r for r in rows if r[0] != 401])  # its products do not fit 64 bits
    wide = df.withColumns({c: F.lit("clash") for c in ("id", "anchor", "size", "norm2", "v", "pos", "_at", "bound", "rank")})
    assert got(hard_negatives(wide, F.col("vec_id") % 50 == 0, bucket_rows=16, range_rows=40)) == want
    assert hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") == 7777).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.uniform(0.5e6, 1e6, 4)], k % 3) for k in range(200)]  # scores over 2**53
    found = hard_negatives(spark.createDataFrame(rows, ROW), F.col("vec_id") % 50 == 0)
    assert got(found) == brute(rows) and max(r[4] for r in got(found)) > 2**53


def test_repeated_rows_count_as_often_as_they_stand(spark):
    rows = [(0, [1.0], 0), (1, [1.0], 0), (1, [1.0], 0), (2, [0.8], 1), (2, [0.8], 1)]
    assert [r[1:4] for r in got(hard_negatives(spark.createDataFrame(rows, ROW), F.col("vec_id") == 0))] == [(1, 1, 2), (1, 1, 2), (1, 2, 2), (1, 2, 2)]
