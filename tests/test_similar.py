"""The similarity search against all pairs."""

import math
import random

import pytest

from tidewell.operators.similar import top_similar


def brute(series, k):
    by = {}
    for user, pos, risk in series:
        by.setdefault(user, []).append((pos, risk))
    vectors = {u: [r for _, r in sorted(v)] for u, v in by.items()}
    out = []
    for a, x in vectors.items():
        best = []
        for b, y in vectors.items():
            norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
            if a == b or len(x) != len(y) or norm == 0:
                continue
            similarity = math.floor(sum(p * q for p, q in zip(x, y)) / norm * 1e9 + 0.501) / 1e9
            if similarity > 0:
                best.append((-similarity, b))
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(sorted(best)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows,signed", [(7, False), (7, True), (1000, False)])
def test_top_similar_equals_all_pairs(spark, block_rows, signed):
    random.seed(block_rows + signed)
    series = []
    for user in range(150):
        n = random.choice([1, 4, 4, 4, 9])
        series += [(user, p, random.gauss(0, 1) if signed else random.random()) for p in range(n)]
    series += [(200 + u, p, [0.5, 0.25, 0.75, 0.5][p]) for u in range(20) for p in range(4)]  # ties
    series += [(300, p, 0.0) for p in range(4)]
    df = spark.createDataFrame(series, "user_id long, pos long, risk double")
    got = sorted((r["a"], r["b"], r["similarity"], r["rank"]) for r in top_similar(df, 3, research=True, block_rows=block_rows).collect())
    want = brute(series, 3)
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
    assert all(abs(g[2] - w[2]) < 2e-9 for g, w in zip(got, want))
    some = spark.createDataFrame([(3,), (200,)], "user_id long")
    assert sorted(r["a"] for r in top_similar(df, 3, research=True, queries=some, block_rows=block_rows).collect()) == sorted(a for a, *_ in want if a in (3, 200))
    assert top_similar(df.limit(0), 3, research=True).count() == 0


def test_flag_is_needed(spark):
    with pytest.raises(PermissionError):
        top_similar(spark.createDataFrame([], "user_id long, pos long, risk double"))
