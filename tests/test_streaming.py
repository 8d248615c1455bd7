"""Streams over several micro-batches equal the batch operators on all rows."""

import math
import random

from pyspark.sql import functions as F

from tidewell.operators.ordered import series_summary
from tidewell.schemas import TABLE_DDL
from tidewell.streaming import checkins as st

FOLDER = "/root/testdata/sf0.001"


def deliveries(spark, folder, parts=3):
    """The events in ``parts`` files by time."""
    rows = spark.read.schema(TABLE_DDL["events"]).parquet(f"{FOLDER}/events.parquet")
    cut = rows.selectExpr("*", f"CAST(event_id * {parts} / 1000 AS INT) AS part")
    for p in range(parts):
        cut.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return rows.selectExpr("event_id AS id", "user_id", "ts", "least(value / 200, 1D) AS risk")


def test_running_trend_over_micro_batches(spark, tmp_path):
    batch = deliveries(spark, tmp_path / "in")
    stream = st.arriving_files(spark, str(tmp_path / "in"), TABLE_DDL["events"], per_batch=1)
    scores = stream.selectExpr("event_id AS id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "least(value / 200, 1D) AS risk")
    updates = st.stream_to_table(st.running_trend(scores, gap_days=2, watermark="1 hour"), "trend")
    assert updates.select("batch").distinct().count() >= 3
    got = {r["user_id"]: r for r in st.newest_update(updates.filter("event = 'score'"), ["user_id"]).collect()}
    want = {r["user_id"]: r for r in series_summary(batch).collect()}
    assert set(got) == set(want)
    for user, w in want.items():
        g = got[user]
        assert (g["n"], g["current_risk"], g["high"]) == (w["n"], w["last"], w["n_high"])
        for a, b in (("average_risk", "mean"), ("slope", "slope"), ("exponential_trend", "ema")):
            assert math.isclose(g[a], w[b], abs_tol=1e-9)


def test_shuffled_deliveries_equal_the_batch(spark, tmp_path):
    rows = spark.read.schema(TABLE_DDL["events"]).parquet(f"{FOLDER}/events.parquet")
    for p in range(4):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.arriving_files(spark, str(tmp_path / "in"), TABLE_DDL["events"], per_batch=1)
    scores = stream.selectExpr("event_id AS id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "least(value / 200, 1D) AS risk")
    updates = st.stream_to_table(st.running_trend(scores, gap_days=2, watermark="60 days"), "shuffled")
    got = {r["user_id"]: r for r in st.newest_update(updates.filter("event = 'score'"), ["user_id"]).collect()}
    want = {r["user_id"]: r for r in series_summary(rows.selectExpr("event_id AS id", "user_id", "ts", "least(value / 200, 1D) AS risk")).collect()}
    for user, w in want.items():
        g = got[user]
        assert (g["n"], g["current_risk"], g["high"], g["n_gaps"]) == (w["n"], w["last"], w["n_high"], w["n_gaps"])
        for a, b in (("slope", "slope"), ("exponential_trend", "ema")):
            assert math.isclose(g[a], w[b], abs_tol=1e-9)


def test_profile_updates_and_dedup(spark, tmp_path):
    deliveries(spark, tmp_path / "in")
    stream = st.arriving_files(spark, str(tmp_path / "in"), TABLE_DDL["events"], per_batch=1)
    out = st.stream_to_table(st.incremental_profile(stream.selectExpr("user_id", "ts", "value / 200 AS risk")), "profile", "update")
    got = {r["user_id"]: r["sessions"] for r in st.newest_update(out, ["user_id"]).collect()}
    rows = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert got == {r["user_id"]: r["count"] for r in rows.groupBy("user_id").count().collect()}
    queue = st.once_per_batch_id(stream.selectExpr("CAST(ts AS TIMESTAMP) AS ts", "CAST(user_id AS STRING) AS batch_id"), watermark="60 days")
    ids = [r["batch_id"] for r in st.stream_to_table(queue, "queue").collect()]
    assert len(ids) == len(set(ids)) == len(got)


def test_missing_checkin_timer(spark, tmp_path):
    deliveries(spark, tmp_path / "in")
    stream = st.arriving_files(spark, str(tmp_path / "in"), TABLE_DDL["events"], per_batch=1)
    scores = stream.selectExpr("event_id AS id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "least(value / 200, 1D) AS risk")
    out = st.stream_to_table(st.running_trend(scores, gap_days=1, watermark="1 hour"), "timer")
    away = {r["user_id"] for r in out.filter("event = 'missing_checkins'").collect()}
    last = spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("t"))
    end = last.agg(F.max("t")).first()[0]
    silent = {r["user_id"] for r in last.collect() if (end - r["t"]).total_seconds() > 86400 + 3600}
    assert silent and silent <= away


def trailing_by_hand(rows, days, step):
    out = {}
    for user, ts, risk in rows:
        first = (ts // (step * 86400) + 1) * step * 86400
        for k in range(days // step):
            out.setdefault((user, first + k * step * 86400), []).append(risk)
    return {key: (len(v), sum(v) / len(v), max(v)) for key, v in out.items()}


def test_trailing_windows_from_panes(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(-200, 200) * 86400 + rng.randrange(86400), rng.random()) for _ in range(120)] + [(7, 86400 * 5, 0.5), (8, 0, 0.1), (8, -1, 0.2)]
    df = spark.createDataFrame(rows, "user_id long, s long, risk double").selectExpr("user_id", "timestamp_seconds(s) AS ts", "risk")
    for days, step in ((1, 1), (7, 1), (90, 1), (180, 1), (21, 7), (28, 28)):
        got = st.trailing_summary(df, days, step).selectExpr("user_id", "unix_seconds(until) AS until", "n", "mean_risk", "peak_risk").collect()
        want = trailing_by_hand(rows, days, step)
        assert {(r["user_id"], r["until"]) for r in got} == set(want) and len(got) == len(want)
        for r in got:
            n, mean, peak = want[r["user_id"], r["until"]]
            assert (r["n"], r["peak_risk"]) == (n, peak) and math.isclose(r["mean_risk"], mean, abs_tol=1e-12)


def test_trailing_windows_are_not_shuffled_per_step(spark):
    df = spark.range(4000).selectExpr("id % 4 AS user_id", "timestamp_seconds(id * 21600) AS ts", "rand(3) AS risk")
    plan = st.trailing_summary(df, 180)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # panes, then panes by user: none after the windows are spread
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate explode")]


def test_trailing_windows_of_a_stream(spark, tmp_path):
    batch = deliveries(spark, tmp_path / "in")
    stream = st.arriving_files(spark, str(tmp_path / "in"), TABLE_DDL["events"], per_batch=1)
    scores = stream.selectExpr("event_id AS id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "least(value / 200, 1D) AS risk")
    got = st.stream_to_table(st.trailing_summary(scores, 7, watermark="1 hour"), "trailing").collect()
    want = {(r["user_id"], r["until"]): (r["n"], r["peak_risk"]) for r in st.trailing_summary(batch.withColumn("ts", F.col("ts").cast("timestamp")), 7).collect()}
    assert got and len(got) == len({(r["user_id"], r["until"]) for r in got})
    assert all(want[r["user_id"], r["until"]] == (r["n"], r["peak_risk"]) for r in got)  # those that the watermark has closed


def test_state_ends_and_begins_anew(spark, tmp_path):
    """A user away for longer than the expiry starts again; text ids, null risks and equal times are kept apart."""
    day = 86_400
    files = [
        [("u", "b", 0, 0.2), ("u", "a", 0, 0.1), ("w", "z", 0, 0.9), ("u", "n", 1, None)],
        [("w", "y", 20 * day, 0.8)],
        [("w", "x", 40 * day, 0.7)],
        [("u", "c", 60 * day, 0.5), ("w", "v", 60 * day, 0.6)],
    ]
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "user_id string, id string, s long, risk double").selectExpr("user_id", "id", "timestamp_seconds(s + 864000) AS ts", "risk")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.arriving_files(spark, str(tmp_path / "in"), "user_id string, id string, ts timestamp, risk double", per_batch=1)
    rows = st.stream_to_table(st.running_trend(stream, gap_days=5, watermark="1 day", expire_days=15), "expiry").collect()
    u = sorted((r["batch"], r["event"], r["n"], r["current_risk"]) for r in rows if r["user_id"] == "u")
    assert [(e, n, x) for _, e, n, x in u][:2] == [("score", 2, 0.2), ("missing_checkins", 2, 0.2)]
    assert [(e, n, x) for _, e, n, x in u if n == 1] == [("score", 1, 0.5)] and len(u) == 3
    assert max(r["n"] for r in rows if r["user_id"] == "w") == 4  # the watermark never was 15 days past the last of these
