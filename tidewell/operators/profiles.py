"""Per-user profile documents built from the fact tables.

Every part is a grouped aggregate with map-side combine. Maps and lists hold one entry per distinct
name (a closed vocabulary), never one per event.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import number_text, r4, rounded
from tidewell.operators import series as sr
from tidewell.operators.bands import band_join
from tidewell.operators.ordered import SLICE_ROWS, series_summary
from tidewell.operators.timelines import latest_per, newest
from tidewell.schemas import BEHAVIOUR_FIELDS, CATALOG, CATALOG_DDL, RULES, RULES_DDL, SEED_STATEMENT, STATE_SENTENCES, STORY, SUGGESTION_SENTENCES, TWIN_PROFILES


def _name_counts(fact: DataFrame, name: str, ts: str, row_id: str) -> DataFrame:
    return fact.filter(f"{name} IS NOT NULL AND {name} <> ''").groupBy("user_id", name).agg(
        F.count("*").alias("n"), F.min(F.struct(ts, row_id)).alias("seen")
    )


def emotion_profile(emotion: DataFrame) -> DataFrame:
    """Mean, spread, stability, dominant and rare emotions (TW1).

    ``emotion`` has ``user_id, id, ts, emotion, prob``. The spread is taken around the rounded mean;
    the emotion seen first wins a tie.
    """
    moments = emotion.groupBy("user_id").agg(F.avg("prob").alias("m"), F.var_pop("prob").alias("v"))
    shift = F.col("m") - r4("m")
    moments = moments.select("user_id", r4("m").alias("average_emotion_score"), r4(F.sqrt(F.col("v") + shift * shift)).alias("variability"))
    names = _name_counts(emotion, "emotion", "ts", "id").groupBy("user_id").agg(
        F.min_by("emotion", F.struct(-F.col("n"), F.col("seen"))).alias("dominant_emotion"),
        F.expr(
            "transform(array_sort(collect_list(if(n = 1, struct(seen, emotion), NULL))), r -> r.emotion)"
        ).alias("rare_emotions"),
    )
    return moments.join(names, "user_id", "left").select(
        "user_id",
        "average_emotion_score",
        "variability",
        r4(F.greatest(F.lit(0.0), 1 - F.col("variability"))).alias("stability"),
        F.coalesce("dominant_emotion", F.lit("Neutral")).alias("dominant_emotion"),
        F.coalesce("rare_emotions", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("rare_emotions"),
    )


def symptom_rows(symptom: DataFrame) -> DataFrame:
    """Frequency and last severity per (user, symptom), in order of first appearance (TW2)."""
    return (
        symptom.filter("symptom IS NOT NULL AND symptom <> ''")
        .groupBy("user_id", "symptom")
        .agg(
            F.count("*").alias("frequency"),
            F.max_by("severity", F.struct("ts", "id")).alias("severity"),
            F.min(F.struct("ts", "id")).alias("seen"),
        )
    )


def symptom_profile(symptom: DataFrame, recurring_from: int = 3) -> DataFrame:
    kept = f"transform(array_sort(collect_list(if(frequency >= {recurring_from}, struct(seen, symptom), NULL))), r -> r.symptom)"
    return symptom_rows(symptom).groupBy("user_id").agg(
        F.expr("map_from_entries(collect_list(struct(symptom, frequency)))").alias("frequency"),
        F.expr("map_from_entries(collect_list(struct(symptom, severity)))").alias("severity"),
        F.expr(kept).alias("recurring"),
    )


def behaviour_profile(behaviour: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Mean value, then the latest value of each named behaviour overrides its field (TW3)."""
    fields = fields or BEHAVIOUR_FIELDS
    targets = sorted(set(fields.values()) | {"facial_activity"})
    name = F.lower("behaviour")
    aggs = [F.avg("value").alias("_mean"), F.count("*").alias("session_count")]
    for target in targets:
        named = [k for k, v in fields.items() if v == target]
        hit = name.isin(named) if named else F.lit(False)
        aggs.append(F.max_by(F.when(hit, F.col("value")), F.when(hit, F.struct("ts", "id"))).alias(target))
    out = behaviour.groupBy("user_id").agg(*aggs)
    return out.select(
        "user_id",
        *[F.coalesce(t, r4("_mean") if t == "facial_activity" else F.lit(0.0)).alias(t) for t in targets],
        "session_count",
    )


def recovery_profile(summary: DataFrame, recommendation: DataFrame) -> DataFrame:
    """Risk reduction, speed and compliance (TW4)."""
    done = recommendation.groupBy("user_id").agg(
        F.count_if(F.col("status") == "completed").alias("_done"), F.count("*").alias("_all")
    )
    drop = F.when(F.col("n") >= 2, F.col("first") - F.col("last")).otherwise(0.0)
    return summary.join(done, "user_id", "left").select(
        "user_id",
        r4(drop).alias("risk_reduction"),
        r4(F.when(F.col("n") >= 2, drop / F.col("n")).otherwise(0.0)).alias("improvement_speed"),
        r4(F.coalesce(F.col("_done") / F.greatest("_all", F.lit(1)), F.lit(0.0))).alias("recommendation_compliance"),
        F.greatest(F.lit(0.0), r4(drop)).alias("recovery_rate"),
        F.coalesce("_all", F.lit(0)).alias("recommendation_count"),
    )


def interaction_profile(session: DataFrame) -> DataFrame:
    """Session counts, mean duration and engagement (TW5)."""
    n = F.count("*")
    return session.groupBy("user_id").agg(
        n.alias("total_sessions"),
        rounded(F.avg("duration"), 2).alias("avg_session_duration"),
        F.count_if("offline_mode").alias("offline_sessions"),
        F.count_if("edge_processing").alias("edge_sessions"),
        r4(F.least(F.lit(1.0), n / 12.0)).alias("engagement_score"),
    )


def language_profile(user: DataFrame, session: DataFrame) -> DataFrame:
    """Preferred language and the number of switches (TW6)."""
    used = session.groupBy("user_id").agg(F.count_distinct("language").alias("_langs"))
    return used.join(user.select("user_id", "preferred_language"), "user_id", "left").select(
        "user_id",
        F.coalesce("preferred_language", F.lit("en")).alias("preferred_language"),
        F.greatest(F.lit(0).cast("long"), F.col("_langs") - 1).alias("language_switching_count"),
    )


def evolution_score(profile: DataFrame) -> DataFrame:
    """Six capped components, their mean and the maturity band (TW7).

    Needs ``sessions, variability, stability, recommendation_compliance, embedding_count``.
    """
    parts = {
        "knowledge_growth": F.least(F.lit(1.0), F.col("sessions") / 20.0),
        "behaviour_stability": 1.0 - F.least(F.lit(1.0), F.col("variability")),
        "prediction_stability": F.col("stability"),
        "recommendation_effectiveness": F.col("recommendation_compliance"),
        "embedding_consistency": F.least(F.lit(1.0), F.col("embedding_count") / F.greatest("sessions", F.lit(1))),
        "temporal_completeness": F.least(F.lit(1.0), F.col("sessions") / 12.0),
    }
    out = profile.select("user_id", *[r4(expr).alias(name) for name, expr in parts.items()])
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(name)
    out = out.withColumn("overall_score", r4(total / len(parts)))
    band = F.when(F.col("overall_score") >= 0.7, "mature").when(F.col("overall_score") >= 0.4, "developing").otherwise("nascent")
    return out.withColumn("maturity", band)


def twin(
    user: DataFrame,
    session: DataFrame,
    score: DataFrame,
    emotion: DataFrame,
    symptom: DataFrame,
    behaviour: DataFrame,
    recommendation: DataFrame,
    embedding: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One profile row per user (TW8); the id derives from the user, so re-runs agree."""
    summary = series_summary(score, slice_rows=slice_rows)
    out = (
        interaction_profile(session)
        .join(summary.select("user_id", F.col("n").alias("risk_history_length"), F.col("last").alias("latest_risk")), "user_id", "left")
        .join(emotion_profile(emotion), "user_id", "left")
        .join(symptom_profile(symptom), "user_id", "left")
        .join(behaviour_profile(behaviour).drop("session_count"), "user_id", "left")
        .join(recovery_profile(summary, recommendation), "user_id", "left")
        .join(language_profile(user, session), "user_id", "left")
    )
    if embedding is not None:
        counts = embedding.groupBy("user_id").agg(F.count("*").alias("embedding_count"))
        out = out.join(counts, "user_id", "left").withColumn("embedding_count", F.coalesce("embedding_count", F.lit(0)))
    else:
        out = out.withColumn("embedding_count", F.lit(0).cast("long"))
    defaults = {"variability": 0.0, "stability": 1.0, "recommendation_compliance": 0.0, "risk_reduction": 0.0}
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out.withColumn("sessions", F.col("total_sessions")).withColumn(
        "twin_id", F.substring(F.sha2(F.concat(F.lit("twin:"), F.col("user_id").cast("string")), 256), 1, 16)
    )


def twin_struct(profile: DataFrame) -> DataFrame:
    """The flat profile as nested groups, the shape of the exported document."""
    groups = {
        "emotion_profile": ["average_emotion_score", "variability", "stability", "dominant_emotion", "rare_emotions"],
        "symptom_profile": ["frequency", "severity", "recurring"],
        "behaviour_profile": sorted(set(BEHAVIOUR_FIELDS.values())),
        "recovery_profile": ["risk_reduction", "improvement_speed", "recommendation_compliance", "recovery_rate"],
        "interaction_profile": ["total_sessions", "avg_session_duration", "offline_sessions", "edge_sessions", "engagement_score"],
        "language_profile": ["preferred_language", "language_switching_count"],
    }
    return profile.select(
        "user_id", "twin_id", *[F.struct(*cols).alias(name) for name, cols in groups.items()], "risk_history_length", "latest_risk"
    )


def dashboard(parts: dict[str, DataFrame]) -> DataFrame:
    """Timelines of several kinds in one table (TW9). Each part has ``user_id, ts, item, value``."""
    out = None
    for kind, df in parts.items():
        part = df.select("user_id", F.lit(kind).alias("kind"), "ts", F.col("item").cast("string").alias("item"), F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def compare_snapshots(snapshots: DataFrame, a: str, b: str) -> DataFrame:
    """Score and session change between two snapshots of each user (TW10)."""
    agg = snapshots.filter(F.col("snapshot_id").isin(a, b)).groupBy("user_id").agg(
        *[F.max(F.when(F.col("snapshot_id") == s, F.col(c))).alias(f"{c}_{n}")
          for n, s in (("a", a), ("b", b)) for c in ("overall_score", "sessions")],
        F.count_distinct("snapshot_id").alias("_found"),
    )
    return agg.filter("_found = 2").select(
        "user_id",
        r4(F.col("overall_score_b") - F.col("overall_score_a")).alias("evolution_delta"),
        (F.col("sessions_b") - F.col("sessions_a")).alias("sessions_delta"),
    )


def window_summaries(session: DataFrame, profile: DataFrame, as_of: str, windows=(30, 90, 180, 365)) -> DataFrame:
    """Sessions per trailing window with the profile facts, one pass over the sessions (AGG21)."""
    at = F.lit(as_of).cast("timestamp_ntz")
    counts = session.groupBy("user_id").agg(
        *[F.count_if((F.col("timestamp") >= at - F.make_dt_interval(F.lit(d))) & (F.col("timestamp") <= at)).alias(f"sessions_{d}_day") for d in windows]
    )
    return counts.join(profile, "user_id").select(
        "user_id",
        *[f"sessions_{d}_day" for d in windows],
        F.col("engagement_score").alias("engagement"),
        "dominant_emotion",
        F.when(F.col("risk_reduction") > 0, "improving").otherwise("stable").alias("risk_trend"),
        F.col("variability").alias("mood_volatility"),
    )


def latest_views(views: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Newest row per (user, view type) (TW12); ``views`` maps type -> (rows, value, ts)."""
    out = None
    for kind, (df, value, ts) in views.items():
        part = df.groupBy("user_id").agg(
            F.max_by(F.col(value).cast("string"), F.struct(ts, "id")).alias("latest_value"), F.max(ts).alias("ts")
        ).withColumn("view_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


# --- attention ----------------------------------------------------------------------------------
def node_attention(emotion: DataFrame, symptom: DataFrame, behaviour: DataFrame, session: DataFrame) -> DataFrame:
    """Recent facts of four kinds with their weights, ranked per user (TOP4)."""
    def recent(df, label, item, weight, ts, row_id, n):
        return newest(df, ts, row_id, n).select(
            "user_id", F.lit(label).alias("label"), F.coalesce(F.col(item).cast("string"), F.lit("unknown")).alias("id"),
            F.col(weight).alias("weight"), F.col("rank").alias("age"),
        )

    rows = (
        recent(emotion, "Emotion", "emotion", "prob", "ts", "id", 5)
        .unionByName(recent(symptom, "Symptom", "symptom", "severity", "ts", "id", 5))
        .unionByName(recent(behaviour, "Behaviour", "behaviour", "value", "ts", "id", 3))
        .unionByName(recent(session, "Session", "session_id", "quality_score", "timestamp", "session_id", 3))
    )
    place = F.expr("CASE label WHEN 'Emotion' THEN 0 WHEN 'Symptom' THEN 1 WHEN 'Behaviour' THEN 2 ELSE 3 END")
    return latest_per(rows, ["user_id"], [F.desc("weight"), place, F.desc("age")], 16).drop("age")


def heatmap(attention: DataFrame, n: int = 10) -> DataFrame:
    """``label:id`` to weight for the first ``n``; a repeated key keeps the later weight."""
    return (
        attention.filter(F.col("rank") <= n)
        .groupBy("user_id", F.concat_ws(":", "label", "id").alias("cell"))
        .agg(F.max_by("weight", "rank").alias("weight"))
    )


# --- suggestions --------------------------------------------------------------------------------
def catalog(spark) -> DataFrame:
    """The fixed 13-row catalog."""
    return spark.createDataFrame(CATALOG, CATALOG_DDL)


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, RULES_DDL)


def risk_matches(current: DataFrame, table: DataFrame) -> DataFrame:
    """Catalog rows whose band holds the current risk, both ends included (JN13); the catalog may be of any size."""
    return band_join(current, table, "current_risk", "min_risk", "max_risk")


def scored_suggestions(current: DataFrame, table: DataFrame, seen: DataFrame | None = None, penalty: float = 0.15) -> DataFrame:
    """Priority score and confidence of every fitting catalog row (TOP6).

    ``current`` has ``user_id, current_risk, compliance``; ``seen`` has ``user_id, type``.
    """
    rows = risk_matches(current, table)
    if seen is not None:
        marks = seen.select("user_id", "type").distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(marks, ["user_id", "type"], "left")
    else:
        rows = rows.withColumn("_seen", F.lit(None).cast("boolean"))
    fit = 1.0 - F.abs(F.col("current_risk") - (F.col("min_risk") + F.col("max_risk")) / 2)
    score = (
        F.col("benefit") * 0.35 + F.col("urgency") * 0.25 + F.col("compliance") * 0.3 + fit * 0.1
        + F.when(F.col("tier") == "high", F.col("urgency") * 0.2).otherwise(0.0)
        - F.when(F.col("_seen"), penalty).otherwise(0.0)
    )
    return rows.withColumn("_score", score).select(
        "user_id", "type", "tier", "current_risk",
        r4("_score").alias("priority_score"),
        r4(F.least(F.lit(1.0), F.col("_score") * 0.9 + 0.1)).alias("confidence"),
    )


def diversified(scored: DataFrame, n: int = 8) -> DataFrame:
    """Top n with tier variety (TOP7): the first two and the first of each tier go first.

    Each user has at most 13 rows here (the catalog), so the windows stay small.
    """
    order = "ORDER BY priority_score DESC, type"
    ranked = scored.selectExpr(
        "*", f"row_number() OVER (PARTITION BY user_id {order}) AS _r", f"row_number() OVER (PARTITION BY user_id, tier {order}) AS _t"
    ).selectExpr("*", "IF(_r <= 2 OR _t = 1, 0, 1) AS _pass")
    return (
        ranked.selectExpr("*", f"CAST(row_number() OVER (PARTITION BY user_id ORDER BY _pass, priority_score DESC, type) AS BIGINT) AS rank")
        .filter(F.col("rank") <= n)
        .drop("_r", "_t", "_pass")
    )


def rule_suggestions(current: DataFrame, table: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Rules that fit the last risk; confidence is risk + 0.1, weak ones are left out (MUT11)."""
    rows = risk_matches(current, table).withColumn("confidence", F.least(F.lit(1.0), F.col("current_risk") + 0.1))
    return rows.filter(F.col("confidence") >= min_confidence).select("user_id", "intervention_type", "current_risk", "confidence")


# --- text from facts ----------------------------------------------------------------------------
def sentence(template: str, **values: Column) -> Column:
    """A fixed sentence with each ``{name}`` replaced by a column; null if one of them is."""
    pieces: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        pieces.append(F.lit(text))
        if name:
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def node_link(twin: DataFrame, key: str = "user_id") -> DataFrame:
    """Node-link document per user: the user, its profiles and the links between them (SNK8)."""
    user = F.col(key).cast("string")
    nodes = [F.struct(i.alias("id"), n.alias("label")) for i, n in [(user, F.lit("User")), *((F.lit(k), F.lit(v)) for k, v in TWIN_PROFILES.items())]]
    links = [F.struct(user.alias("source"), F.lit(k).alias("target"), F.lit("HAS_PROFILE").alias("type")) for k in TWIN_PROFILES]
    graph = F.struct(
        F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.create_map().cast("map<string,string>").alias("graph"),
        F.array(*nodes).alias("nodes"), F.array(*links).alias("links"),
    )
    return twin.select(key, F.to_json(graph).alias("node_link"))


def seed_statements(twin: DataFrame, key: str = "user_id") -> DataFrame:
    """One statement per user that creates its twin with all columns as properties (SNK8)."""
    props = F.to_json(F.struct(*[F.col(c) for c in twin.columns]))
    return twin.select(key, sentence(SEED_STATEMENT, user_id=F.col(key), props=props).alias("statement"))


def story(profile: DataFrame, evolution: DataFrame, window_days: int = 30) -> DataFrame:
    """A factual summary sentence chain per user (TXT22)."""
    rows = profile.join(evolution.select("user_id", "recovery_probability"), "user_id", "left")
    change = F.when(F.col("risk_reduction") > 0.05, STORY["improving"]).when(F.col("risk_reduction") < -0.05, STORY["worsening"]).otherwise(STORY["stable"])
    parts = F.concat_ws(
        " ",
        sentence(STORY["sessions"], days=F.lit(str(window_days)), sessions=F.col("sessions")),
        F.when(F.col("dominant_emotion") != "Neutral", sentence(STORY["emotion"], emotion=F.col("dominant_emotion"), stability=F.format_string("%.2f", rounded("stability", 2)))),
        change,
        F.when(F.size("recurring") > 0, sentence(STORY["recurring"], recurring=F.array_join(F.slice("recurring", 1, 3), ", "))),
        F.when(F.col("recovery_probability") > 0.6, STORY["momentum"]),
    )
    return rows.select("user_id", F.when(F.col("sessions") == 0, STORY["empty"]).otherwise(parts).alias("narrative"))


def state_explanation(latest: DataFrame, emotions: DataFrame, symptoms: DataFrame, max_path: int = 6) -> DataFrame:
    """Latest risk, strongest emotion and symptom as text and path (TXT23).

    ``latest`` has ``user_id, session, risk``; the other two are top-1 rows per user.
    """
    rows = latest.join(emotions.select("user_id", "emotion"), "user_id", "left").join(symptoms.select("user_id", "symptom"), "user_id", "left")
    path = F.array_compact(
        F.array(
            F.lit("User"), F.lit("Session"), F.when(F.col("emotion").isNotNull(), "Emotion"),
            F.when(F.col("symptom").isNotNull(), "Symptom"), F.lit("Prediction"),
        )
    )
    text = F.concat_ws(
        " ",
        sentence(STATE_SENTENCES["risk"], risk=number_text("risk"), session=F.col("session")),
        F.when(F.col("emotion").isNotNull(), sentence(STATE_SENTENCES["emotion"], emotion=F.col("emotion"))),
        F.when(F.col("symptom").isNotNull(), sentence(STATE_SENTENCES["symptom"], symptom=F.col("symptom"))),
    )
    return rows.select(
        "user_id",
        F.array_join(F.slice(path, 1, max_path), " > ").alias("reasoning_path"),
        F.when(text == "", "Insufficient graph data for explanation.").otherwise(text).alias("explanation"),
    )


def suggestion_explanation(suggestions: DataFrame, profile: DataFrame) -> DataFrame:
    """Why each suggestion was made (TXT23, TW16)."""
    rows = suggestions.join(profile.select("user_id", "recurring", "dominant_emotion", "recommendation_compliance", "risk_history_length"), "user_id")
    percent = F.floor(F.col("recommendation_compliance") * 100 + 0.5).cast("long")
    why = F.concat_ws(
        " ",
        sentence(SUGGESTION_SENTENCES["type"], type=F.col("type")),
        F.when(F.col("risk_history_length") > 0, sentence(SUGGESTION_SENTENCES["tier"], tier=F.col("tier"))),
        F.when(F.size("recurring") > 0, sentence(SUGGESTION_SENTENCES["recurring"], recurring=F.array_join(F.slice("recurring", 1, 3), ", "))),
        F.when(F.col("dominant_emotion").isNotNull(), sentence(SUGGESTION_SENTENCES["emotion"], emotion=F.col("dominant_emotion"))),
        sentence(SUGGESTION_SENTENCES["compliance"], compliance=percent),
    )
    return rows.select("user_id", "rank", "type", "tier", why.alias("why"))


# --- reports ------------------------------------------------------------------------------------
def reasoning_report(
    score: DataFrame, emotion: DataFrame, symptom: DataFrame, session: DataFrame, gap_days: int = 7, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Trend, state, anomalies, patterns, counts and alerts of each user in one row (TW11)."""
    negative = emotion.filter("negative")
    inputs = sr.alert_inputs(score, negative.withColumnRenamed("prob", "probability"), gap_days, slice_rows)
    base = sr.trend_record(
        inputs,
        sr.temporal_state(F.col("n_gaps")).alias("state"),
        sr.long_term_direction().alias("long_term_trend"),
        F.coalesce(r4(sr.z_score()) >= 2, F.lit(False)).alias("risk_anomaly"),
        F.col("n_gaps").alias("missing_checkins"),
        F.when(F.col("last") < F.col("first"), "improving").otherwise("declining").alias("improvement"),
        F.size(F.array_compact(F.array(*[F.when(c, k) for k, (c, _) in sr.alert_conditions().items()]))).cast("long").alias("alerts"),
    )
    persistent = symptom_rows(symptom).groupBy("user_id").agg(F.count_if(F.col("frequency") >= 3).alias("persistent_symptoms"))
    sessions = session.groupBy("user_id").agg(F.count("*").alias("sessions"))
    return base.join(sr.emotion_stability(emotion.withColumnRenamed("prob", "probability")).select("user_id", F.col("stability").alias("emotion_stability")), "user_id", "left").join(
        persistent, "user_id", "left"
    ).join(sessions, "user_id", "left")
