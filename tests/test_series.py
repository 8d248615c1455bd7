"""Literal series with values worked out by hand, and sliced against unsliced computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import series as sr
from tidewell.operators.ordered import exact_quantiles, running_totals, sequenced, series_summary

CASES = {
    1: ([0.3, 0.4, 0.5, 0.6, 0.7], 0.1, 0.0, 0.6, 0.5227, (0.3614, 0.6386), "relapse"),
    2: ([0.3, 0.4, 0.5, 0.7, 0.8], 0.13, -0.1, 0.6667, 0.5737, (0.3582, 0.7218), "relapse"),
    3: ([0.8, 0.7, 0.5, 0.4, 0.3], -0.13, 0.0, 0.4, 0.5116, (0.3582, 0.7218), "stable"),
    4: ([0.3, 0.3, 0.3, 0.9], 0.18, 0.6, 0.5, 0.48, (0.156, 0.744), "sudden_change"),
}


def frame(spark, series):
    rows = [(u, i, float(i * 3600), float(x)) for u, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "user_id BIGINT, id BIGINT, s DOUBLE, risk DOUBLE")
    return df.select("user_id", "id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "risk")


@pytest.mark.parametrize("slice_rows", [2, 1_000_000])
def test_literal_trends(spark, slice_rows):
    summary = series_summary(frame(spark, {k: v[0] for k, v in CASES.items()}), slice_rows=slice_rows)
    got = {r["user_id"]: r for r in sr.trend_record(summary).join(sr.temporal_states(summary).select("user_id", "state"), "user_id").collect()}
    for user, (_, slope, acc, ma, ema, ci, state) in CASES.items():
        r = got[user]
        assert (r["slope"], r["moving_average"], r["exponential_trend"]) == (slope, ma, ema)
        assert abs(r["acceleration"] - acc) < 1e-9
        assert (r["ci_low"], r["ci_high"]) == ci
        assert r["state"] == state


def test_forecast_and_short_series(spark):
    summary = series_summary(frame(spark, {1: CASES[1][0], 2: [0.4]}))
    got = {r["user_id"]: r for r in sr.risk_evolution(summary).collect()}
    assert (got[1]["forecast_7d"], got[1]["forecast_30d"], got[1]["forecast_90d"]) == (0.8167, 1.0, 1.0)
    assert got[2]["temporal_state"] == "insufficient_data"
    assert got[2]["forecast_7d"] == 0.4 and got[2]["recovery_probability"] == 0.5 and got[2]["relapse_probability"] == 0.2


def test_constant_history_is_flagged(spark):
    rows = sr.unexpected_increase(series_summary(frame(spark, {4: CASES[4][0]}))).collect()
    assert len(rows) == 1 and rows[0]["z_score"] >= 2


def skewed(spark):
    """One user holds most rows, with repeated times and a burst."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        user = 1 if i % 3 else rng.randint(2, 30)
        at = rng.choice([rng.uniform(0, 40 * 86400), 86400.0 * rng.randint(0, 5)])
        rows.append((user, i, at, rng.randint(0, 100) / 100))
    df = spark.createDataFrame(rows, "user_id BIGINT, id BIGINT, s DOUBLE, risk DOUBLE")
    return rows, df.select("user_id", "id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "risk")


def test_sliced_summary_equals_plain_python(spark):
    rows, df = skewed(spark)
    by_user = {}
    for user, i, at, x in rows:
        by_user.setdefault(user, []).append((round(at, 6), i, x))
    for slice_rows in (7, 50, 10_000):
        got = {r["user_id"]: r for r in series_summary(df, slice_rows=slice_rows).collect()}
        assert set(got) == set(by_user)
        for user, items in by_user.items():
            items.sort()
            xs = [x for _, _, x in items]
            n, r = len(xs), got[user]
            assert (r["n"], r["first"], r["last"]) == (n, xs[0], xs[-1])
            assert r["prev"] == (xs[-2] if n > 1 else None) and r["prev3"] == (xs[-4] if n > 3 else None)
            ema = xs[0]
            for x in xs[1:]:
                ema = 0.3 * x + 0.7 * ema
            mean = sum(xs) / n
            mid = (n - 1) / 2
            den = sum((i - mid) ** 2 for i in range(n)) or 1.0
            slope = sum((i - mid) * (x - mean) for i, x in enumerate(xs)) / den
            assert math.isclose(r["ema"], ema, abs_tol=1e-9) and math.isclose(r["slope"], slope, abs_tol=1e-9)
            assert math.isclose(r["m2"], sum((x - mean) ** 2 for x in xs), abs_tol=1e-9)
            if n > 1:
                deltas = [b - a for a, b in zip(xs, xs[1:])]
                assert math.isclose(r["delta_low"], min(deltas), abs_tol=1e-12) and math.isclose(r["delta_peak"], max(deltas), abs_tol=1e-12)
                gaps = [(b[0] - a[0]) / 86400 for a, b in zip(items, items[1:])]
                assert r["gap_max_days"] == math.floor(max(gaps)) and r["n_gaps"] == sum(math.floor(g) > 7 for g in gaps)
                base = sum(xs[:-1]) / (n - 1)
                assert math.isclose(r["base_mean"], base, abs_tol=1e-9)
                assert math.isclose(r["base_m2"], sum((x - base) ** 2 for x in xs[:-1]), abs_tol=1e-9)


def test_sliced_positions_and_previous_rows(spark):
    _, df = skewed(spark)
    plain = sequenced(df, ["user_id"], ["ts", "id"], {"before": "risk"}, total="n")
    sliced = sequenced(df, ["user_id"], ["ts", "id"], {"before": "risk"}, total="n", slice_rows=6)
    columns = ["user_id", "id", "pos", "n", "before"]
    assert sorted(map(tuple, plain.select(columns).collect()), key=str) == sorted(map(tuple, sliced.select(columns).collect()), key=str)


def test_running_totals_and_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 5.0, rng.random()]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    counts = df.groupBy("x").agg(F.count("*").alias("n"))
    for down in (False, True):
        got = {r["x"]: r["n_before"] for r in running_totals(counts, "x", ["n"], down, slice_rows=10).collect()}
        for v in set(values):
            assert got[v] == sum((w > v) if down else (w < v) for w in values)
    row = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], slice_rows=10).first()
    ordered = sorted(values)
    for name, q in (("q0", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 1.0)):
        at = (len(ordered) - 1) * q
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert math.isclose(row[name], low + (high - low) * (at - math.floor(at)), abs_tol=1e-12)


def test_alerts(spark):
    scores = frame(spark, {1: [0.3, 0.75, 0.8, 0.96], 2: [0.2, 0.2]}).withColumn("confidence", F.lit(0.9))
    got = {(r["user_id"], r["alert_type"]): r["severity"] for r in sr.alerts(sr.alert_inputs(scores)).collect()}
    assert got == {(1, "risk_increase"): "medium", (1, "repeated_high_risk"): "high", (1, "rapid_deterioration"): "high"}


def test_mean_of_decimal_figures_meets_its_threshold(spark):
    from tidewell.functions.numeric import exact_mean

    mood = {1: [0.59, 0.05, 0.86], 2: [0.7, 0.7, 0.1], 3: [0.7, 0.1, 0.7], 4: [0.4, 0.6, 0.49], 5: [0.9, float("inf")], 6: [None]}
    rows = spark.createDataFrame([(u, x) for u, xs in mood.items() for x in xs], "user_id BIGINT, x DOUBLE")
    got = {r["user_id"]: r["m"] for r in rows.groupBy("user_id").agg(exact_mean("x").alias("m")).collect()}
    assert got[1] == got[2] == got[3] == 0.5 and got[4] < 0.5 and got[5] == float("inf") and got[6] is None
    scores = frame(spark, {u: [0.1, 0.1] for u in (1, 2, 3, 4)}).withColumn("confidence", F.lit(1.0))
    moods = spark.createDataFrame([(u, x) for u in (1, 2, 3, 4) for x in mood[u]], "user_id BIGINT, probability DOUBLE").coalesce(1)
    alerts = sr.alerts(sr.alert_inputs(scores, moods), mood=0.5).filter("alert_type = 'persistent_negative_mood'")
    assert sorted(r["user_id"] for r in alerts.collect()) == [1, 2, 3]


def test_rows_of_one_arrival_number_follow_by_time(spark):
    rows = [(1, 5, 30), (1, 5, 10), (1, 5, 20), (1, 6, 15), (1, 4, 25)]
    for slice_rows in (2, 1_000_000):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "user_id BIGINT, id BIGINT, ts BIGINT").coalesce(1)
            got = sorted(tuple(r) for r in sr.order_violations(df, slice_rows=slice_rows).collect())
            assert got == [(1, 2, 5, 10, 25), (1, 5, 6, 15, 30)]


def test_figures_in_sentences_have_no_java_exponent(spark):
    from tidewell.functions.numeric import number_text

    values = [0.00015, 1.0e-4, 0.0005, 0.00099, 0.5, 1.0, 0.0, 12345678.0, 123456789.25, 5e-05, 1.25e-07, 1e16, 1.5e300, -0.00025, -5e-05, 2.5e-310, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x DOUBLE").select("i", number_text("x").alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: None if v is None else repr(v) for i, v in enumerate(values)}
