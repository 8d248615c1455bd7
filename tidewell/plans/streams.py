"""Streaming operators run over the event files, and their windows as batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.numeric import r9
from tidewell.plans.registry import add, q9
from tidewell.plans.series import alert_sql
from tidewell.schemas import TABLE_DDL
from tidewell.session import work_folder
from tidewell.streaming import checkins as st

K = "CAST(get_json_object(props, '$.k') AS INT)"


def events(t):
    return st.arriving_files(t.spark, t.folder, TABLE_DDL["events"], "events*.parquet")


def scores(t):
    return events(t).selectExpr("event_id AS id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "least(value / 200, 1D) AS risk")


def nested(t):
    return events(t).selectExpr("user_id", "event_id AS session_id", "least(value / 200, 1D) AS risk_probability", f"{K} / 100.0D AS confidence", "ts",
                                f"array(named_struct('name', event_type, 'value', {K} / 100.0D)) AS emotions", f"array(named_struct('name', event_type, 'value', {K} / 50.0D)) AS symptoms",
                                "array(named_struct('name', 'b', 'value', value)) AS behaviours", f"array(named_struct('type', event_type, 'priority', {K} % 4)) AS recommendations")


def ingested(t):
    folder = work_folder(t.spark, "ingest")
    st.ingest(nested(t), f"{folder}/tables", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/tables/edge").groupBy("rel_type").agg(F.count("*").alias("n"))


add("STR1_checkin_ingest", ingested, "SELECT v.k AS rel_type, count(*) * v.m AS n FROM events, (VALUES ('PRODUCED', 1), ('ESTIMATES', 1), ('IDENTIFIED', 3), ('GENERATED_REC', 1)) v(k, m) GROUP BY v.k, v.m")


def trend_updates(t):
    return st.stream_to_table(st.running_trend(scores(t), gap_days=2, watermark="1 hour"), "trend")


add("STR2_running_trend", lambda t: st.newest_update(trend_updates(t).filter("event = 'score'"), ["user_id"]).select(
        "user_id", "n", "current_risk", *[r9(c).alias(c) for c in ("average_risk", "slope", "moving_average", "exponential_trend", "step")], "high"),
    f"SELECT user_id, n, last AS current_risk, {q9('mean')} AS average_risk, {q9('slope')} AS slope, {q9('(last + coalesce(prev, 0e0) + coalesce(prev2, 0e0)) / least(n, 3)')} AS moving_average, {q9('ema')} AS exponential_trend, "
    f"{q9('coalesce(last - prev, 0e0)')} AS step, n_high AS high FROM trend", "trend")
SERIES_ALERTS = ("risk_increase", "repeated_high_risk", "rapid_deterioration", "missing_checkins", "low_confidence")


def stream_alerts(t):
    """Alerts of each user after the last of the stream's scores."""
    graded = events(t).selectExpr("event_id AS id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "least(value / 200, 1D) AS risk", f"{K} / 100.0D AS confidence")
    trend = st.running_trend(graded, gap_days=2, watermark="1 hour", alert_gap_days=1)
    latest = st.newest_update(st.stream_to_table(trend, "alerts").filter("event = 'score'").withColumn("event", F.lit("score")), ["user_id"])
    return st.trend_alerts(latest, slope=0.002).withColumn("value", r9("value"))


add("STR2_stream_alerts", stream_alerts, " UNION ALL ".join(alert_sql(k) for k in SERIES_ALERTS), "trend emotion")
add("STR3_missing_timer", lambda t: trend_updates(t).filter("event = 'missing_checkins'").select("user_id", "n"),
    "SELECT user_id, n FROM trend WHERE epoch_ms(last_ts) + 2 * 86400000 <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000", "trend")
add("STR4_offline_queue", lambda t: st.stream_to_table(st.once_per_batch_id(events(t).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "concat(user_id, '-', event_type) AS batch_id"), watermark="60 days"), "queue").select("batch_id"),
    "SELECT DISTINCT user_id || '-' || event_type AS batch_id FROM events")
for _d in (1, 7, 30):
    add(f"STR5_summary_{_d}_days", lambda t, d=_d: st.period_summary(t.score, d).withColumn("mean_risk", r9("mean_risk")),
        f"SELECT user_id, make_timestamp(CAST(floor(epoch_us(ts) / ({_d} * 86400e6)) AS BIGINT) * {_d} * 86400000000) AS start, count(*) AS n, {q9('avg(risk)')} AS mean_risk, max(risk) AS peak_risk FROM score GROUP BY 1, 2", "score")
for _d in (7, 30, 90, 180):
    add(f"STR6_trailing_{_d}_days", lambda t, d=_d: st.trailing_summary(t.score, d, 1).withColumn("mean_risk", r9("mean_risk")),
        f"SELECT user_id, e + to_days(CAST(i AS INTEGER) * 1) AS until, count(*) AS n, {q9('avg(risk)')} AS mean_risk, max(risk) AS peak_risk FROM (SELECT user_id, risk, make_timestamp((CAST(floor(epoch_us(ts) / (1 * 86400e6)) AS BIGINT) + 1) * 1 * 86400000000) AS e, "
        f"unnest(range(0, {_d // 1})) AS i FROM score) GROUP BY 1, 2", "score")
add("STR7_bursts", lambda t: st.bursts(t.score, "6 hours").withColumn("mean_risk", r9("mean_risk")),
    f"SELECT user_id, min(ts) AS start, count(*) AS n, {q9('avg(risk)')} AS mean_risk FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 25e-2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id) AS b FROM seq) GROUP BY user_id, b", "seq")


def late(t):
    """Two deliveries: every third event arrives a day's batch too late."""
    folder = work_folder(t.spark, "late")
    rows = t.events.select("event_id", "user_id", "ts")
    rows.filter("event_id % 3 <> 0").write.parquet(f"{folder}/in/part=0")
    rows.filter("event_id % 3 = 0").write.parquet(f"{folder}/in/part=1")
    write = st.late_splitter(f"{folder}/out")
    for part in (0, 1):
        write(t.spark.read.parquet(f"{folder}/in/part={part}"), part)
    return t.spark.read.parquet(f"{folder}/out/late").select("event_id", "user_id")


add("STR8_late_rows", late,
    "SELECT event_id, e.user_id FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events WHERE event_id % 3 <> 0 GROUP BY 1) s ON s.user_id = e.user_id WHERE event_id % 3 = 0 AND ts < m")


def audited(t):
    folder = work_folder(t.spark, "audit")
    st.audit_stream(events(t).selectExpr("event_type AS operation", "CAST(event_id AS STRING) AS entity_id"), f"{folder}/log", f"{folder}/checkpoint")
    return t.spark.read.schema("operation STRING, entity_id STRING").json(f"{folder}/log").groupBy("operation").agg(F.count("*").alias("n"))


add("STR9_audit_stream", audited, "SELECT event_type AS operation, count(*) AS n FROM events GROUP BY 1")
add("STR10_incremental_profile", lambda t: st.newest_update(st.stream_to_table(st.incremental_profile(scores(t)), "profile", "update"), ["user_id"]).select("user_id", "sessions", r9("average_risk").alias("average_risk"), "peak_risk", "engagement_score"),
    f"SELECT user_id, n AS sessions, {q9('mean')} AS average_risk, peak AS peak_risk, least(1e0, n / 12e0) AS engagement_score FROM trend", "trend")
add("STR11_arriving_files", lambda t: st.stream_to_table(events(t).select("event_id"), "arrived").groupBy().agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events")
