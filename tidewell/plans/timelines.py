"""Projections, path joins, per-user lists and plain per-user aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.numeric import r9
from tidewell.operators import timelines as tl
from tidewell.operators.ordered import series_summary
from tidewell.plans.registry import add, q9

# --- projections --------------------------------------------------------------------------------
add("PRJ1_point_lookup", lambda t: tl.point_lookup(t.user, "user_id", 7, live_only=True),
    "SELECT * FROM usr WHERE user_id = 7 AND deleted_at IS NULL LIMIT 1", "usr")
add("PRJ2_alias_resolution", lambda t: t.prediction.select(
        "prediction_id", tl.first_present("risk_probability", "risk_score").alias("risk")),
    "SELECT prediction_id, coalesce(risk_probability, risk_score) AS risk FROM prediction", "prediction")
add("PRJ3_not_deleted", lambda t: tl.not_deleted(t.session).select("session_id", "user_id", "timestamp"),
    "SELECT session_id, user_id, timestamp FROM session WHERE deleted_at IS NULL", "session")
add("PRJ4_soft_deleted_nodes", lambda t: tl.soft_deleted({
        "Session": (t.session.withColumn("deleted_at", F.when(F.col("deleted_at").isNotNull(), "yes")), "session_id"),
        "User": (t.user, "user_id")}),
    "SELECT user_id AS owner, 'Session' AS label, CAST(session_id AS VARCHAR) AS uuid, 'yes' AS deleted_at FROM session "
    "WHERE deleted_at IS NOT NULL UNION ALL SELECT user_id, 'User', CAST(user_id AS VARCHAR), deleted_at FROM usr "
    "WHERE deleted_at IS NOT NULL", "session usr")
_REC = ("SELECT r.user_id, recommendation_id AS id, coalesce(recommendation_type, intervention_type) AS type, priority, status, "
        "confidence, coalesce(generated_at, r.timestamp) AS ts FROM recommendation r JOIN session s ON r.session_id = s.session_id")
_TOP = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rank FROM"
add("PRJ5_current_recommendations", lambda t: tl.current_recommendations(t.session, t.recommendation),
    f"SELECT * FROM ({_TOP} ({_REC} WHERE status IN ('pending', 'active'))) WHERE rank <= 10", "recommendation session")
add("PRJ6_high_risk_sessions", lambda t: tl.high_risk_sessions(t.prediction),
    "SELECT session_id, user_id, coalesce(risk_probability, risk_score) AS risk, created_at AS ts FROM prediction "
    "WHERE coalesce(risk_probability, risk_score) >= 7e-1", "prediction")
add("PRJ17_quality_over_time", lambda t: t.session.select("user_id", "session_id", "quality_score", "offline_mode", "timestamp"),
    "SELECT user_id, session_id, quality_score, offline_mode, timestamp FROM session", "session")
add("PRJ11_owner_scope", lambda t: tl.readable_by(t.session.withColumnRenamed("user_id", "owner"), 8).select("session_id", "owner"),
    "SELECT session_id, user_id AS owner FROM session WHERE user_id = 8", "session")
add("PRJ12_blocked_columns", lambda t: tl.without_blocked(
        t.events.select("event_id", "event_type", F.col("props").alias("raw_media"), F.col("value").alias("secret"))),
    "SELECT event_id, event_type FROM events")

# --- joins --------------------------------------------------------------------------------------
add("JN1_user_timeline", lambda t: tl.user_timeline(t.user, t.session).select("user_id", "session_id", "timestamp", "pos"),
    "SELECT s.user_id, session_id, timestamp, row_number() OVER (PARTITION BY s.user_id ORDER BY timestamp, session_id) AS pos "
    "FROM session s JOIN usr u ON s.user_id = u.user_id WHERE s.deleted_at IS NULL", "session usr")
add("JN2_risk_progression", lambda t: tl.risk_progression(t.user, t.session, t.prediction),
    "SELECT s.user_id, p.session_id AS session, prediction_id, coalesce(risk_probability, risk_score) AS risk, confidence, created_at AS ts "
    "FROM usr u JOIN session s ON u.user_id = s.user_id JOIN prediction p ON p.session_id = s.session_id", "usr session prediction")
add("JN3_emotion_evolution", lambda t: tl.fact_evolution(t.session, t.emotion, "emotion", ["probability", "confidence"], tl.EMOTION_LINKS),
    "SELECT s.user_id, emotion_id AS id, coalesce(emotion_name, emotion) AS emotion, probability, confidence, e.timestamp AS ts "
    "FROM session s JOIN emotion e ON e.session_id = s.session_id WHERE rel_type IN ('EXPRESSES', 'IDENTIFIED')", "session emotion")
add("JN3_symptom_progression", lambda t: tl.fact_evolution(t.session, t.symptom, "symptom", ["severity", "confidence"], tl.SYMPTOM_LINKS),
    "SELECT s.user_id, symptom_id AS id, coalesce(symptom_name, symptom) AS symptom, severity, confidence, e.timestamp AS ts "
    "FROM session s JOIN symptom e ON e.session_id = s.session_id WHERE rel_type IN ('INDICATES', 'IDENTIFIED')", "session symptom")
_BEH = ("SELECT s.user_id, behaviour_id AS id, coalesce(behaviour_name, behaviour) AS behaviour, b.value, b.confidence AS conf, "
        "b.timestamp AS ts FROM session s JOIN prediction p ON p.session_id = s.session_id "
        "JOIN behaviour b ON b.session_id = p.prediction_id WHERE b.rel_type = 'IDENTIFIED'")
add("JN4_behaviour_evolution", lambda t: tl.behaviour_evolution(t.session, t.prediction, t.behaviour), _BEH, "session prediction behaviour")
_ROT = ("SELECT s.user_id, p.session_id AS session, s.timestamp AS session_ts, p.prediction_id, coalesce(risk_probability, risk_score) AS risk, "
        "confidence, created_at AS ts, risk_level, trend FROM session s JOIN prediction p ON p.session_id = s.session_id {} risk r "
        "ON r.prediction_id = p.prediction_id")
add("JN5_risk_over_time", lambda t: tl.risk_over_time(t.session, t.prediction, t.risk), _ROT.format("LEFT JOIN"), "session prediction risk")
add("JN6_risk_timeline", lambda t: tl.risk_timeline(t.session, t.prediction, t.risk), _ROT.format("JOIN"), "session prediction risk")
add("JN7_feedback_summary", lambda t: tl.feedback_summary(t.recommendation, t.feedback),
    "SELECT user_id, r.recommendation_id, status, coalesce(recommendation_type, intervention_type) AS type, count(*) AS interventions "
    "FROM recommendation r JOIN feedback f ON r.recommendation_id = f.recommendation_id GROUP BY ALL", "recommendation feedback")
_PAIRS = ("SELECT user_id, rn - 1 AS pair, from_session, session_id AS to_session, from_ts, timestamp AS to_ts, "
          "CAST(floor((epoch_us(timestamp) - epoch_us(from_ts)) / 86400e6) AS BIGINT) AS gap_days FROM (SELECT user_id, session_id, timestamp, "
          "row_number() OVER w AS rn, lag(session_id) OVER w AS from_session, lag(timestamp) OVER w AS from_ts FROM session "
          "WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, session_id)) WHERE from_session IS NOT NULL")
add("JN8_consecutive_sessions", lambda t: tl.consecutive_sessions(t.session), _PAIRS, "session")
add("JN9_edge_endpoints", lambda t: tl.resolve_edges(t.edge, t.node.filter("label <> 'Symptom'")),
    "SELECT l.src, l.dst, l.rel_type FROM (SELECT e.src, e.dst, e.rel_type FROM edge e JOIN (SELECT DISTINCT node_id AS a FROM node WHERE label <> 'Symptom') ON e.src = a) l "
    "JOIN (SELECT DISTINCT node_id AS b FROM node WHERE label <> 'Symptom') ON l.dst = b",
    "edge node")
add("JN10_label_lookup", lambda t: tl.lookup_or(
        t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.when(F.col("quality") == 1, "normal").otherwise("depression").alias("label")),
        "doc_id", {"label": "unknown"}),
    "SELECT d.doc_id, lang, coalesce(CASE WHEN quality = 1 THEN 'normal' WHEN quality IS NOT NULL THEN 'depression' END, 'unknown') AS label "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("JN11_restrict_index", lambda t: t.dataset_index.join(
        t.dataset_index.filter("quality_score >= 0.5").select("participant_id").distinct(), "participant_id", "left_semi").select("participant_id", "file_path"),
    "SELECT participant_id, file_path FROM dataset_index WHERE participant_id IN (SELECT participant_id FROM dataset_index WHERE quality_score >= 5e-1)",
    "dataset_index")
add("JN12_unassigned_participants", lambda t: t.dataset_index.select("participant_id").distinct().join(
        t.dataset_index.filter("split IS NOT NULL").select("participant_id").distinct(), "participant_id", "left_anti"),
    "SELECT DISTINCT participant_id FROM dataset_index EXCEPT SELECT participant_id FROM dataset_index WHERE split IS NOT NULL", "dataset_index")
add("JN18_risk_trend_rows", lambda t: tl.collected_trend(t.score, "risk", "risk"),
    "SELECT user_id, rn AS pos, id, risk, ts FROM seq WHERE risk IS NOT NULL", "seq")
add("JN18_emotion_trend_rows", lambda t: tl.collected_trend(
        tl.fact_evolution(t.session, t.emotion, "emotion", ["probability"], tl.EMOTION_LINKS), "emotion", "probability"),
    "SELECT s.user_id, row_number() OVER (PARTITION BY s.user_id ORDER BY e.timestamp, emotion_id) AS pos, emotion_id AS id, "
    "coalesce(emotion_name, emotion) AS emotion, probability, e.timestamp AS ts FROM session s JOIN emotion e ON e.session_id = s.session_id "
    "WHERE rel_type IN ('EXPRESSES', 'IDENTIFIED')", "session emotion")
add("JN18_symptom_trend_rows", lambda t: tl.collected_trend(
        tl.fact_evolution(t.session, t.symptom, "symptom", ["severity"], tl.SYMPTOM_LINKS), "symptom", "severity"),
    "SELECT s.user_id, row_number() OVER (PARTITION BY s.user_id ORDER BY e.timestamp, symptom_id) AS pos, symptom_id AS id, "
    "coalesce(symptom_name, symptom) AS symptom, severity, e.timestamp AS ts FROM session s JOIN symptom e ON e.session_id = s.session_id "
    "WHERE rel_type IN ('INDICATES', 'IDENTIFIED')", "session symptom")
add("JN18_behaviour_trend_rows", lambda t: tl.collected_trend(
        tl.behaviour_evolution(t.session, t.prediction, t.behaviour), "behaviour", "value"),
    f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS pos, id, behaviour, value, ts FROM ({_BEH})",
    "session prediction behaviour")
add("JN19_single_edge_variant", lambda t: tl.risk_progression(t.user, t.session, t.prediction, ["PREDICTED"]),
    "SELECT s.user_id, p.session_id AS session, prediction_id, coalesce(risk_probability, risk_score) AS risk, confidence, created_at AS ts "
    "FROM usr u JOIN session s ON u.user_id = s.user_id JOIN prediction p ON p.session_id = s.session_id WHERE rel_type = 'PREDICTED'",
    "usr session prediction")
# The older offline queries: one edge type each, no aliases, no filter on deleted rows.
add("JN19_older_emotion_evolution", lambda t: tl.older_evolution(t.session, t.emotion, "emotion", "probability", "EXPRESSES"),
    "SELECT s.user_id, e.emotion, probability, e.timestamp AS ts FROM session s JOIN emotion e ON e.session_id = s.session_id WHERE rel_type = 'EXPRESSES'", "session emotion")
add("JN19_older_symptom_evolution", lambda t: tl.older_evolution(t.session, t.symptom, "symptom", "confidence", "INDICATES"),
    "SELECT s.user_id, e.symptom, e.confidence, e.timestamp AS ts FROM session s JOIN symptom e ON e.session_id = s.session_id WHERE rel_type = 'INDICATES'", "session symptom")
add("JN19_older_graph_statistics", lambda t: t.node.agg(F.count("*").alias("nodes")).crossJoin(t.edge.agg(F.count("*").alias("edges"))),
    "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS edges", "node edge")
add("JN19_older_session_history", lambda t: tl.newest(t.session.select("user_id", "session_id", "timestamp"), "timestamp", "session_id", 12),
    "SELECT * FROM (SELECT user_id, session_id, timestamp, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, session_id DESC) AS rank FROM session) WHERE rank <= 12", "session")

add("JN19_older_user_timeline", lambda t: tl.older_timeline(t.user, t.session),
    "SELECT u.user_id, session_id, timestamp FROM usr u JOIN session s ON s.user_id = u.user_id", "usr session")
add("JN19_older_risk_progression", lambda t: tl.older_risk_progression(t.user, t.session, t.prediction),
    "SELECT u.user_id, s.session_id AS session, risk_score AS risk, created_at AS ts FROM usr u JOIN session s ON s.user_id = u.user_id JOIN prediction p ON p.session_id = s.session_id WHERE rel_type = 'PREDICTED'", "usr session prediction")
add("JN19_older_high_risk_sessions", lambda t: tl.older_high_risk(t.session, t.prediction),
    "SELECT DISTINCT s.session_id AS session, risk_score AS risk FROM session s JOIN prediction p ON p.session_id = s.session_id WHERE rel_type = 'PREDICTED' AND risk_score >= 7e-1", "session prediction")

# --- top n --------------------------------------------------------------------------------------
add("TOP1_latest_session", lambda t: tl.session_history(t.session, 1).select("user_id", "session_id", "timestamp"),
    "SELECT user_id, session_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, session_id DESC) AS r "
    "FROM session WHERE deleted_at IS NULL) WHERE r = 1", "session")
add("TOP2_session_history", lambda t: tl.session_history(t.session, 12).select("user_id", "session_id", "timestamp", "rank"),
    "SELECT user_id, session_id, timestamp, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, session_id DESC) AS r "
    "FROM session WHERE deleted_at IS NULL) WHERE r <= 12", "session")
add("TOP2_prediction_history", lambda t: tl.newest(t.score, "ts", "id", 50),
    f"SELECT * FROM ({_TOP} score) WHERE rank <= 50", "score")
for _kind, _measure in (("emotion", "probability"), ("symptom", "severity")):
    add(f"TOP3_strongest_{_kind}s", lambda t, kind=_kind, m=_measure: tl.latest_per(
            getattr(t, kind).select("user_id", F.col(f"{kind}_id").alias("id"), tl.first_present(f"{kind}_name", kind).alias(kind), m, F.col("timestamp").alias("ts")),
            ["user_id"], [F.desc(m), F.col("ts"), F.col("id")], 3),
        f"SELECT * FROM (SELECT user_id, {_kind}_id AS id, coalesce({_kind}_name, {_kind}) AS {_kind}, {_measure}, timestamp AS ts, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY {_measure} DESC, timestamp, {_kind}_id) AS rank FROM {_kind}) WHERE rank <= 3", _kind)
add("TOP13_recommendation_history", lambda t: tl.recommendation_history(t.session, t.recommendation),
    f"SELECT * FROM ({_TOP} ({_REC})) WHERE rank <= 50", "recommendation session")

# --- aggregates ---------------------------------------------------------------------------------
add("AGG2_average_risk", lambda t: tl.average_risk(t.score).withColumn("average_risk", r9("average_risk")),
    f"SELECT user_id, {q9('avg(risk)')} AS average_risk, count(risk) AS n FROM score GROUP BY user_id", "score")
add("AGG3_peak_risk_users", lambda t: tl.peak_risk_users(t.score),
    "SELECT user_id, max(risk) AS peak_risk FROM score GROUP BY user_id HAVING max(risk) >= 7e-1 ORDER BY peak_risk DESC, user_id LIMIT 100", "score")
add("AGG4_legacy_high_risk", lambda t: tl.legacy_high_risk(t.prediction),
    "SELECT DISTINCT session_id AS session, risk_score AS risk FROM prediction WHERE rel_type = 'PREDICTED' AND risk_score >= 7e-1", "prediction")
add("AGG5_improvement_trend", lambda t: tl.improvement_trend(series_summary(t.score)),
    "SELECT user_id, first AS first_risk, last AS latest_risk, last - first AS delta, CASE WHEN last < first THEN 'improving' ELSE 'declining' END AS trend "
    "FROM trend WHERE n >= 2", "trend")
add("AGG6_decline_trend", lambda t: tl.decline_trend(series_summary(t.score)),
    "SELECT user_id, prev2 AS risk_3_ago, last AS latest, last - prev2 AS recent_delta, last > prev2 AS declining FROM trend WHERE n >= 3", "trend")
add("AGG19_weekly_summary", lambda t: tl.weekly_summary(t.score).withColumn("mean_risk", r9("mean_risk")),
    f"SELECT user_id, make_timestamp(CAST(floor(epoch_us(ts) / 604800e6) AS BIGINT) * 604800000000) AS week_start, count(*) AS n, {q9('avg(risk)')} AS mean_risk "
    "FROM score GROUP BY ALL", "score")
add("AGG20_clinical_trends", lambda t: tl.clinical_trends(t.prediction, t.emotion, t.symptom),
    "SELECT user_id, count(*) AS risk_points, count(*) AS emotion_points, count(*) AS symptom_points, count(*) >= 3 AS available FROM checkin GROUP BY user_id",
    "checkin")
add("AGG16_emotion_frequency", lambda t: t.emotion.groupBy(tl.first_present("emotion_name", "emotion").alias("emotion")).agg(F.count("*").alias("n")).orderBy(F.desc("n")),
    "SELECT coalesce(emotion_name, emotion) AS emotion, count(*) AS n FROM emotion GROUP BY 1 ORDER BY n DESC", "emotion")
add("AGG17_repeated_items", lambda t: t.checkin.groupBy("user_id", F.col("event_type").alias("item")).agg(F.count("*").alias("n")).filter("n >= 2"),
    "SELECT user_id, event_type AS item, count(*) AS n FROM checkin GROUP BY ALL HAVING count(*) >= 2", "checkin")
add("AGG24_latency_summary", lambda t: t.checkin.groupBy(F.col("event_type").alias("operation")).agg(
        F.count("*").alias("n"), r9(F.avg("value")).alias("avg_ms"), F.max("value").alias("max_ms"), F.count_if(F.col("value") <= 50).alias("within_target")),
    f"SELECT event_type AS operation, count(*) AS n, {q9('avg(value)')} AS avg_ms, max(value) AS max_ms, count(CASE WHEN value <= 50 THEN 1 END) AS within_target "
    "FROM checkin GROUP BY ALL", "checkin")
add("DT1_sessions_in_window", lambda t: tl.sessions_since(t.session, 7).select("session_id", "user_id", "timestamp"),
    "SELECT session_id, user_id, timestamp FROM session WHERE timestamp >= (SELECT max(timestamp) FROM session) - INTERVAL 7 DAY", "session")
add("DT2_timestamp_problems", lambda t: tl.timestamp_problems(
        t.checkin.select("id", F.when(F.col("k") % 9 == 0, "not a time").when(F.col("k") % 9 == 1, "2031-01-01 00:00:00").otherwise("2024-01-01 00:00:00").alias("at")),
        "at", "id", "2025-01-01 00:00:00"),
    "SELECT id, CASE WHEN k % 9 = 0 THEN 'invalid' ELSE 'future' END AS problem FROM checkin WHERE k % 9 IN (0, 1)", "checkin")
add("JSN1_json_properties", lambda t: t.events.select("event_id", F.to_json(F.from_json("props", "k int")).alias("props"), F.from_json("props", "k int")["k"].alias("k")),
    "SELECT event_id, '{\"k\":' || k || '}' AS props, k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
