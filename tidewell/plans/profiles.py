"""Profiles, attention, suggestions and per-user reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.numeric import r9
from tidewell.operators import profiles as pf
from tidewell.operators import series as sr
from tidewell.operators import timelines as tl
from tidewell.operators.bands import band_join
from tidewell.operators.ordered import series_summary
from tidewell.plans.registry import add, q4, q9
from tidewell.plans.series import EVOLUTION, RECORD, RECOVERY, STATE, STATE0, S4, Z
from tidewell.schemas import CATALOG, RULES

FIELDS = {"click": "speech_rate", "view": "voice_energy", "error": "facial_activity"}


def emo(t):
    return t.emotion.selectExpr("user_id", "emotion_id AS id", "timestamp AS ts", "coalesce(emotion_name, emotion) AS emotion", "probability AS prob",
                                "coalesce(emotion_name, emotion) = 'error' AS negative")


def sym(t):
    return t.symptom.selectExpr("user_id", "symptom_id AS id", "timestamp AS ts", "coalesce(symptom_name, symptom) AS symptom", "severity")


def beh(t):
    return t.behaviour.selectExpr("user_id", "behaviour_id AS id", "timestamp AS ts", "coalesce(behaviour_name, behaviour) AS behaviour", "value")


def rec(t):
    return t.recommendation.selectExpr("user_id", "recommendation_id AS id", "coalesce(recommendation_type, intervention_type) AS type", "status",
                                       "confidence", "coalesce(generated_at, timestamp) AS ts")


def flat_twin(t):
    return pf.twin(t.user, t.session, t.score, emo(t), sym(t), beh(t), rec(t))


def flatten_lists(df):
    for name, kind in df.dtypes:
        if kind == "array<string>":
            df = df.withColumn(name, F.array_join(name, ","))
        elif kind.startswith("map<"):
            pair = f"transform(array_sort(map_entries({name})), e -> concat(e.key, '=', CAST(e.value AS STRING)))"
            df = df.withColumn(name, F.array_join(F.expr(pair), ","))
    return df


EMO = "SELECT user_id, id, ts, event_type AS emotion, k / 1e2 AS prob FROM checkin"
EMO_P = (f"SELECT user_id, {q4('m')} AS average_emotion_score, {q4(f'sqrt(v + pow(m - {q4(chr(109))}, 2))')} AS variability FROM "
         f"(SELECT user_id, avg(prob) AS m, var_pop(prob) AS v FROM ({EMO}) GROUP BY 1)")
EMO_N = ("SELECT user_id, arg_min(emotion, (-n, seen)) AS dominant_emotion, coalesce(array_to_string(list(emotion ORDER BY seen) FILTER (WHERE n = 1), ','), '') AS rare_emotions "
         f"FROM (SELECT user_id, emotion, count(*) AS n, min((ts, id)) AS seen FROM ({EMO}) GROUP BY 1, 2) GROUP BY 1")
EMO_ALL = (f"SELECT a.user_id, average_emotion_score, variability, {q4('greatest(0e0, 1 - variability)')} AS stability, dominant_emotion, rare_emotions "
           f"FROM ({EMO_P}) a JOIN ({EMO_N}) b ON a.user_id = b.user_id")
SYM_R = "SELECT user_id, event_type AS symptom, count(*) AS frequency, arg_max(k / 1e2, (ts, id)) AS severity, min((ts, id)) AS seen FROM checkin GROUP BY 1, 2"
REC = ("SELECT user_id, id, event_type AS type, CASE WHEN k % 3 = 0 THEN 'pending' WHEN k % 3 = 1 THEN 'active' ELSE 'completed' END AS status, "
       "k / 1e2 AS confidence, ts FROM checkin WHERE event_type IN ('click', 'purchase', 'signup')")
DONE = f"SELECT user_id AS du, count(CASE WHEN status = 'completed' THEN 1 END) AS done, count(*) AS made FROM ({REC}) GROUP BY 1"
RECOV = (f"SELECT user_id, {q4('CASE WHEN n >= 2 THEN first - last ELSE 0e0 END')} AS risk_reduction, {q4('CASE WHEN n >= 2 THEN (first - last) / n ELSE 0e0 END')} AS improvement_speed, "
         f"{q4('coalesce(done / CAST(greatest(made, 1) AS DOUBLE), 0e0)')} AS recommendation_compliance, greatest(0e0, {q4('CASE WHEN n >= 2 THEN first - last ELSE 0e0 END')}) AS recovery_rate, "
         f"coalesce(made, 0) AS recommendation_count FROM trend LEFT JOIN ({DONE}) ON du = user_id")
INTER = ("SELECT user_id, count(*) AS total_sessions, floor(avg(duration) * 1e2 + 5000001e-7) / 1e2 AS avg_session_duration, count(CASE WHEN offline_mode THEN 1 END) AS offline_sessions, "
         f"count(CASE WHEN edge_processing THEN 1 END) AS edge_sessions, {q4('least(1e0, count(*) / 12e0)')} AS engagement_score FROM session GROUP BY 1")
PROFILE = (f"SELECT i.user_id, total_sessions AS sessions, engagement_score, average_emotion_score, variability, stability, dominant_emotion, rare_emotions, recurring, "
           f"risk_reduction, recommendation_compliance, n AS risk_history_length, last AS latest_risk FROM ({INTER}) i JOIN ({EMO_ALL}) e ON e.user_id = i.user_id "
           f"JOIN (SELECT user_id, coalesce(array_to_string(list(symptom ORDER BY seen) FILTER (WHERE frequency >= 3), ','), '') AS recurring, "
           f"coalesce(list_slice(list(symptom ORDER BY seen) FILTER (WHERE frequency >= 3), 1, 3), []) AS rec3 FROM ({SYM_R}) GROUP BY 1) s ON s.user_id = i.user_id "
           f"JOIN ({RECOV}) r ON r.user_id = i.user_id JOIN trend t ON t.user_id = i.user_id")
V = "trend session"

add("TW1_emotion_profile", lambda t: flatten_lists(pf.emotion_profile(emo(t))), EMO_ALL, "checkin")
add("TW2_symptom_profile", lambda t: pf.symptom_rows(sym(t)).select("user_id", "symptom", "frequency", "severity", (F.col("frequency") >= 3).alias("recurring")),
    f"SELECT user_id, symptom, frequency, severity, frequency >= 3 AS recurring FROM ({SYM_R})", "checkin")
add("TW3_behaviour_profile", lambda t: pf.behaviour_profile(beh(t), FIELDS),
    f"SELECT user_id, coalesce(arg_max(k / 1e2, (ts, id)) FILTER (WHERE event_type = 'click'), 0e0) AS speech_rate, "
    "coalesce(arg_max(k / 1e2, (ts, id)) FILTER (WHERE event_type = 'view'), 0e0) AS voice_energy, "
    f"coalesce(arg_max(k / 1e2, (ts, id)) FILTER (WHERE event_type = 'error'), {q4('avg(k / 1e2)')}) AS facial_activity, count(*) AS session_count FROM checkin GROUP BY 1", "checkin")
add("TW4_recovery_profile", lambda t: pf.recovery_profile(series_summary(t.score), rec(t)), RECOV, "trend")
add("TW5_interaction_profile", lambda t: pf.interaction_profile(t.session), INTER, "session")
add("TW6_language_profile", lambda t: pf.language_profile(t.user, t.session),
    "SELECT s.user_id, coalesce(max(preferred_language), 'en') AS preferred_language, greatest(0, count(DISTINCT language) - 1) AS language_switching_count "
    "FROM session s LEFT JOIN usr u ON u.user_id = s.user_id GROUP BY 1", "session usr")
EVO = (f"SELECT *, CASE WHEN overall_score >= 7e-1 THEN 'mature' WHEN overall_score >= 4e-1 THEN 'developing' ELSE 'nascent' END AS maturity FROM (SELECT *, "
       f"{q4('(knowledge_growth + behaviour_stability + prediction_stability + recommendation_effectiveness + embedding_consistency + temporal_completeness) / 6')} AS overall_score FROM "
       f"(SELECT user_id, {q4('least(1e0, sessions / 2e1)')} AS knowledge_growth, {q4('1 - least(1e0, variability)')} AS behaviour_stability, {q4('stability')} AS prediction_stability, "
       f"{q4('recommendation_compliance')} AS recommendation_effectiveness, 0e0 AS embedding_consistency, {q4('least(1e0, sessions / 12e0)')} AS temporal_completeness FROM ({PROFILE})))")
add("TW7_evolution_score", lambda t: pf.evolution_score(flat_twin(t)), EVO, V)
add("TW8_twin_row", lambda t: flatten_lists(flat_twin(t)).select(
        "user_id", "sessions", "engagement_score", "average_emotion_score", "variability", "stability", "dominant_emotion", "rare_emotions", "recurring",
        "risk_reduction", "recommendation_compliance", "risk_history_length", "latest_risk"), PROFILE, V)
add("TW9_dashboard", lambda t: pf.dashboard({
        "risk": t.score.selectExpr("user_id", "ts", "id AS item", "risk AS value"),
        "emotion": emo(t).selectExpr("user_id", "ts", "emotion AS item", "prob AS value"),
        "symptom": sym(t).selectExpr("user_id", "ts", "symptom AS item", "severity AS value"),
        "behaviour": beh(t).selectExpr("user_id", "ts", "behaviour AS item", "value"),
        "recommendation": rec(t).selectExpr("user_id", "ts", "type AS item", "confidence AS value"),
        "recovery": sr.recovery_timeline(t.score).selectExpr("user_id", "ts", "direction AS item", "risk_delta AS value")}),
    "SELECT user_id, 'risk' AS kind, ts, CAST(id AS VARCHAR) AS item, risk AS value FROM seq UNION ALL "
    + " UNION ALL ".join(f"SELECT user_id, '{k}', ts, event_type, k / 1e2 FROM checkin" for k in ("emotion", "symptom", "behaviour"))
    + f" UNION ALL SELECT user_id, 'recommendation', ts, type, confidence FROM ({REC}) UNION ALL "
    f"SELECT user_id, 'recovery', ts, CASE WHEN d < 0 THEN 'improving' WHEN d > 0 THEN 'declining' ELSE 'stable' END, {q4('d')} FROM seq WHERE d IS NOT NULL", "seq")


def snapshots(t):
    both = [t.session.filter(F.col("timestamp") < day).groupBy("user_id").agg(
        F.lit(name).alias("snapshot_id"), F.count("*").alias("sessions"), F.least(F.lit(1.0), F.count("*") / 20.0).alias("overall_score"))
        for name, day in (("mid", "2024-01-16"), ("end", "2024-02-01"))]
    return both[0].unionByName(both[1])


add("TW10_snapshot_compare", lambda t: pf.compare_snapshots(snapshots(t), "mid", "end"),
    f"SELECT user_id, {q4('least(1e0, b / 2e1) - least(1e0, a / 2e1)')} AS evolution_delta, b - a AS sessions_delta FROM (SELECT user_id, "
    "count(CASE WHEN timestamp < TIMESTAMP '2024-01-16' THEN 1 END) AS a, count(*) AS b FROM session GROUP BY 1) WHERE a > 0", "session")
add("TW11_reasoning_report", lambda t: pf.reasoning_report(t.score, emo(t), sym(t), t.session, gap_days=1).drop("average_risk"),
    f"SELECT t.user_id, {RECORD.replace(q4('mean') + ' AS average_risk, ', '')}, {STATE.format(missing=chr(32) + 'WHEN gaps > 0 THEN ' + chr(39) + 'missing_checkins' + chr(39))} AS state, "
    f"CASE WHEN {S4} > 0 THEN 'increasing' WHEN {S4} < 0 THEN 'decreasing' ELSE 'flat' END AS long_term_trend, coalesce({Z} >= 2, false) AS risk_anomaly, gaps AS missing_checkins, "
    "CASE WHEN last < first THEN 'improving' ELSE 'declining' END AS improvement, "
    f"(coalesce(last - prev >= 15e-2, false))::INT + (n_high >= 3)::INT + ({S4} >= 5e-2)::INT + (gaps > 0)::INT + coalesce(mood_n >= 3 AND mood_mean >= 6e-1, false)::INT + (last_confidence < 5e-1)::INT AS alerts, "
    f"emotion_stability, persistent_symptoms, n AS sessions FROM trend t JOIN (SELECT user_id, count(CASE WHEN floor(gap) > 1 THEN 1 END) AS gaps FROM seq GROUP BY 1) g ON g.user_id = t.user_id "
    f"LEFT JOIN (SELECT user_id AS u, count(*) AS mood_n, avg(k / 1e2) AS mood_mean FROM checkin WHERE event_type = 'error' GROUP BY 1) ON u = t.user_id "
    f"LEFT JOIN (SELECT user_id AS v, {q4('greatest(0e0, 1 - CASE WHEN count(*) >= 2 THEN stddev_pop(k / 1e2) ELSE 0e0 END)')} AS emotion_stability FROM checkin GROUP BY 1) ON v = t.user_id "
    f"LEFT JOIN (SELECT user_id AS w, count(CASE WHEN frequency >= 3 THEN 1 END) AS persistent_symptoms FROM ({SYM_R}) GROUP BY 1) ON w = t.user_id", V)
add("TW12_latest_views", lambda t: pf.latest_views({"emotion": (emo(t), "emotion", "ts"), "symptom": (sym(t), "symptom", "ts")}),
    " UNION ALL ".join(f"SELECT user_id, '{k}' AS view_type, arg_max(event_type, (ts, id)) AS latest_value, max(ts) AS ts FROM checkin GROUP BY 1" for k in ("emotion", "symptom")), "checkin")
def risk_analytics(t):
    s = series_summary(t.score)
    return sr.trend_record(s, sr.temporal_state().alias("state"))


add("TW14_risk_analytics", risk_analytics,
    f"SELECT user_id, {RECORD}, {STATE0} AS state FROM trend", "trend")
add("TW15_emotion_analytics", lambda t: sr.emotion_stability(t.emotion).drop("mean").join(
        emo(t).groupBy("user_id", "emotion").agg(F.count("*").alias("n")), "user_id"),
    f"SELECT c.user_id, {q4('greatest(0e0, 1 - sd)')} AS stability, {q4('sd')} AS volatility, event_type AS emotion, count(*) AS n FROM checkin c JOIN "
    "(SELECT user_id AS u, CASE WHEN count(*) >= 2 THEN stddev_pop(k / 1e2) ELSE 0e0 END AS sd FROM checkin GROUP BY 1) ON u = c.user_id GROUP BY c.user_id, sd, event_type", "checkin")
STORY = ("concat_ws(' ', 'Over the past 30 days, ' || sessions || ' recorded interaction(s) contributed to your evolving profile.', "
         "CASE WHEN dominant_emotion <> 'Neutral' THEN 'Dominant emotional tone observed: ' || dominant_emotion || ' (stability score: ' || printf('%.2f', floor(stability * 1e2 + 5000001e-7) / 1e2) || ').' END, "
         "CASE WHEN risk_reduction > 5e-2 THEN 'Recorded interactions show a gradual improvement in engagement indicators, with decreasing risk scores over time.' "
         "WHEN risk_reduction < -5e-2 THEN 'Recent sessions show increased risk indicators. Consider the supportive recommendations provided.' "
         "ELSE 'Your interaction patterns have remained relatively stable.' END, "
         "CASE WHEN recurring <> '' THEN 'Recurring indicators noted: ' || array_to_string(list_slice(string_split(recurring, ','), 1, 3), ', ') || '.' END, "
         "CASE WHEN recovery_probability > 6e-1 THEN 'Patterns suggest positive momentum in recent sessions.' END)")
add("TXT22_story", lambda t: pf.story(flat_twin(t), sr.risk_evolution(series_summary(t.score))),
    f"SELECT p.user_id, {STORY} AS narrative FROM ({PROFILE}) p JOIN (SELECT user_id, {RECOVERY} AS recovery_probability FROM trend) r ON r.user_id = p.user_id", V)
add("TW13_twin_summary", lambda t: pf.evolution_score(flat_twin(t)).select("user_id", "overall_score", "maturity").join(
        sr.risk_evolution(series_summary(t.score)), "user_id").join(
        t.session.groupBy("user_id").agg(F.count_if(F.col("timestamp") >= "2024-01-16").alias("recent_sessions")), "user_id"),
    f"SELECT a.user_id, overall_score, maturity, b.* EXCLUDE (user_id), recent_sessions FROM ({EVO}) a JOIN (SELECT user_id, {EVOLUTION} FROM trend) b ON a.user_id = b.user_id "
    "JOIN (SELECT user_id, count(CASE WHEN timestamp >= TIMESTAMP '2024-01-16' THEN 1 END) AS recent_sessions FROM session GROUP BY 1) c ON c.user_id = a.user_id", V)
add("AGG21_window_summaries", lambda t: pf.window_summaries(t.session, flat_twin(t), "2024-01-25 00:00:00", (7, 14, 30, 90)),
    "SELECT s.user_id, " + ", ".join(f"count(CASE WHEN timestamp >= TIMESTAMP '2024-01-25' - INTERVAL {d} DAY AND timestamp <= TIMESTAMP '2024-01-25' THEN 1 END) AS sessions_{d}_day" for d in (7, 14, 30, 90))
    + ", max(engagement_score) AS engagement, max(dominant_emotion) AS dominant_emotion, CASE WHEN max(risk_reduction) > 0 THEN 'improving' ELSE 'stable' END AS risk_trend, "
    f"max(variability) AS mood_volatility FROM session s JOIN ({PROFILE}) p ON p.user_id = s.user_id GROUP BY 1", V)
add("AGG18_persistent_symptoms", lambda t: sym(t).groupBy("user_id", "symptom").agg(F.count("*").alias("sessions"), r9(F.avg("severity")).alias("avg_confidence")).filter("sessions >= 3"),
    f"SELECT user_id, event_type AS symptom, count(*) AS sessions, {q9('avg(k / 1e2)')} AS avg_confidence FROM checkin GROUP BY 1, 2 HAVING count(*) >= 3", "checkin")

ATT = " UNION ALL ".join(
    f"SELECT user_id, '{label}' AS label, {place} AS place, {item} AS item, {w} AS weight, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS age, {n} AS keep FROM checkin"
    for place, (label, item, w, n) in enumerate((("Emotion", "event_type", "k / 1e2", 5), ("Symptom", "event_type", "k / 1e2", 5), ("Behaviour", "event_type", "k / 1e2", 3),
                                                 ("Session", "CAST(id AS VARCHAR)", "least(value / 2e2, 1e0)", 3))))
ATT = f"SELECT user_id, label, item AS id, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, place, age DESC) AS rank FROM ({ATT}) WHERE age <= keep"
add("TOP4_node_attention", lambda t: pf.node_attention(emo(t), sym(t), beh(t), t.session), ATT, "checkin")
add("TOP4_heatmap", lambda t: pf.heatmap(pf.node_attention(emo(t), sym(t), beh(t), t.session)),
    f"SELECT user_id, label || ':' || id AS cell, arg_max(weight, rank) AS weight FROM ({ATT}) WHERE rank <= 10 GROUP BY 1, 2", "checkin")
add("TOP5_recommendation_attention", lambda t: tl.newest(rec(t), "ts", "id", 5).select("user_id", "id", "type", F.col("confidence").alias("weight"), "rank"),
    f"SELECT * FROM (SELECT user_id, id, type, confidence AS weight, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rank FROM ({REC})) WHERE rank <= 5", "checkin")

CAT = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c!r}::DOUBLE, {d!r}::DOUBLE, {e!r}::DOUBLE, {f!r}::DOUBLE)" for a, b, c, d, e, f in CATALOG) + ") c(type, tier, min_risk, max_risk, benefit, urgency)"
RULE = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in RULES) + ") c(intervention_type, min_risk, max_risk)"


def current(t):
    s = series_summary(t.score)
    comp = pf.recovery_profile(s, rec(t)).select("user_id", F.col("recommendation_compliance").alias("compliance"))
    # the highest score so far, so that every risk band occurs in the data
    return s.select("user_id", F.col("peak").alias("current_risk")).join(comp, "user_id")


def seen(t):
    return t.checkin.filter("event_type = 'purchase' AND k % 2 = 0").selectExpr("user_id", "'Emergency Helpline' AS type")


CUR = f"SELECT t.user_id, peak AS current_risk, recommendation_compliance AS compliance FROM trend t JOIN ({RECOV}) r ON r.user_id = t.user_id"
SCORE_X = ("benefit * 35e-2 + urgency * 25e-2 + compliance * 3e-1 + (1 - abs(current_risk - (min_risk + max_risk) / 2)) * 1e-1 + CASE WHEN tier = 'high' THEN urgency * 2e-1 ELSE 0e0 END "
           "- CASE WHEN EXISTS (SELECT 1 FROM checkin x WHERE x.user_id = u.user_id AND x.event_type = 'purchase' AND x.k % 2 = 0 AND c.type = 'Emergency Helpline') THEN 15e-2 ELSE 0e0 END")
SCORED = (f"SELECT user_id, type, tier, current_risk, {q4('s')} AS priority_score, {q4('least(1e0, s * 9e-1 + 1e-1)')} AS confidence FROM (SELECT u.user_id, c.type, tier, current_risk, {SCORE_X} AS s "
          f"FROM ({CUR}) u JOIN ({CAT}) c ON current_risk >= min_risk AND current_risk <= max_risk)")
DIVERSE = ("SELECT * FROM (SELECT user_id, type, tier, current_risk, priority_score, confidence, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN r <= 2 OR tr = 1 THEN 0 ELSE 1 END, priority_score DESC, type) AS rank "
           f"FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority_score DESC, type) AS r, row_number() OVER (PARTITION BY user_id, tier ORDER BY priority_score DESC, type) AS tr FROM ({SCORED}))) WHERE rank <= 4")
add("JN13_risk_band_join", lambda t: pf.risk_matches(t.score.selectExpr("user_id", "id", "risk AS current_risk"), pf.catalog(t.spark)).select("user_id", "id", "type"),
    f"SELECT user_id, id, type FROM score JOIN ({CAT}) c ON risk >= min_risk AND risk <= max_risk", "score")
add("JN13_wide_catalog", lambda t: band_join(t.customer.select("c_custkey", "c_acctbal"), t.part.selectExpr("p_partkey", "p_retailprice - p_size / 10e0 AS low", "p_retailprice + p_size * p_size / 100e0 AS high"), "c_acctbal", "low", "high", 0).select("c_custkey", "p_partkey"),
    "SELECT c_custkey, p_partkey FROM customer JOIN part ON c_acctbal >= CAST(p_retailprice AS DOUBLE) - p_size / 1e1 AND c_acctbal <= CAST(p_retailprice AS DOUBLE) + p_size * p_size / 1e2")
add("TOP6_suggestion_scores", lambda t: pf.scored_suggestions(current(t), pf.catalog(t.spark), seen(t)), SCORED, "trend checkin")
add("TOP7_diversified", lambda t: pf.diversified(pf.scored_suggestions(current(t), pf.catalog(t.spark), seen(t)), 4), DIVERSE, "trend checkin")
add("MUT11_rule_suggestions", lambda t: pf.rule_suggestions(current(t), pf.rules(t.spark)),
    f"SELECT * FROM (SELECT user_id, intervention_type, current_risk, least(1e0, current_risk + 1e-1) AS confidence FROM ({CUR}) u JOIN ({RULE}) c ON current_risk >= min_risk AND current_risk <= max_risk) WHERE confidence >= 6e-1",
    "trend checkin")
LATEST = "SELECT user_id, arg_max(id, (ts, id)) AS session, arg_max(risk, (ts, id)) AS risk FROM score GROUP BY 1"
TOPE = "SELECT user_id, event_type AS emotion, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, ts, id) AS r FROM checkin"


def explained(t):
    latest = t.score.groupBy("user_id").agg(F.max_by("id", F.struct("ts", "id")).alias("session"), F.max_by("risk", F.struct("ts", "id")).alias("risk"))
    top_e = tl.latest_per(emo(t), ["user_id"], [F.desc("prob"), F.col("ts"), F.col("id")], 1)
    top_s = tl.latest_per(sym(t), ["user_id"], [F.desc("severity"), F.col("ts"), F.col("id")], 1)
    return pf.state_explanation(latest, top_e, top_s)


add("TXT23_state_explanation", explained,
    "SELECT l.user_id, 'User > Session > Emotion > Symptom > Prediction' AS reasoning_path, 'Latest risk score ' || CAST(risk AS VARCHAR) || ' for session ' || session || '. Dominant emotion: ' || emotion || "
    f"'. Primary symptom indicator: ' || emotion || '.' AS explanation FROM ({LATEST}) l JOIN ({TOPE}) e ON e.user_id = l.user_id AND r = 1", "score checkin")
WHY = ("concat_ws(' ', 'Recommended ' || d.type || ' based on your recorded interaction history.', 'Current risk level supports ' || tier || '-priority guidance.', "
       "CASE WHEN recurring <> '' THEN 'Recurring indicators: ' || array_to_string(list_slice(string_split(recurring, ','), 1, 3), ', ') || '.' END, 'Emotional patterns include ' || dominant_emotion || '.', "
       "'Recommendation confidence reflects ' || CAST(floor(recommendation_compliance * 100 + 5e-1) AS BIGINT) || '% historical engagement with similar suggestions.')")
add("TW16_personal_suggestions", lambda t: pf.suggestion_explanation(
        pf.diversified(pf.scored_suggestions(current(t), pf.catalog(t.spark), seen(t)), 4).filter("rank <= 3"), flat_twin(t)),
    f"SELECT d.user_id, rank, d.type, tier, {WHY} AS why FROM ({DIVERSE}) d JOIN ({PROFILE}) p ON p.user_id = d.user_id WHERE rank <= 3", "trend session checkin")
add("EV20_twin_research_metrics", lambda t: pf.evolution_score(flat_twin(t)).selectExpr(
        "user_id", "knowledge_growth AS graph_contribution", "temporal_completeness AS temporal_contribution", "overall_score AS digital_twin_consistency", "maturity AS twin_maturity"),
    f"SELECT user_id, knowledge_growth AS graph_contribution, temporal_completeness AS temporal_contribution, overall_score AS digital_twin_consistency, maturity AS twin_maturity FROM ({EVO})", V)
