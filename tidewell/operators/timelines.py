"""Timelines, histories and top-n lists for every user at once.

Per-user limits are ``row_number() <= n``: Spark keeps only n rows per user on the map side
(window group limit), so a heavy user never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numeric import elapsed_days
from tidewell.operators.ordered import SLICE_ROWS, sequenced

PREDICTION_LINKS = ("PRODUCED", "PREDICTED")
EMOTION_LINKS = ("EXPRESSES", "IDENTIFIED")
SYMPTOM_LINKS = ("INDICATES", "IDENTIFIED")
RECOMMENDATION_LINKS = ("RECOMMENDS", "GENERATED_REC")
BLOCKED_COLUMNS = ("password", "token", "secret", "raw_media", "media_bytes")


# --- projections and filters --------------------------------------------------------------------
def point_lookup(df: DataFrame, column: str, value: object, live_only: bool = False) -> DataFrame:
    found = df.filter(F.col(column) == F.lit(value))
    return (not_deleted(found) if live_only else found).limit(1)


def not_deleted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def soft_deleted(tables: dict[str, tuple[DataFrame, str]], owner: str = "user_id") -> DataFrame:
    """Deleted rows of several labels; ``tables`` maps label -> (table, id column)."""
    parts = [
        df.filter(F.col("deleted_at").isNotNull()).select(
            F.col(owner).alias("owner"),
            F.lit(label).alias("label"),
            F.col(key).cast("string").alias("uuid"),
            F.col("deleted_at").cast("string").alias("deleted_at"),
        )
        for label, (df, key) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_present(*names: str) -> Column:
    """New name first, legacy alias second (PRJ2)."""
    return F.coalesce(*[F.col(n) for n in names])


def readable_by(df: DataFrame, requester: object, owner: str = "owner") -> DataFrame:
    """Rows a requester may read: the own ones, or all for ``system``."""
    return df if requester == "system" else df.filter(F.col(owner) == F.lit(requester))


def writable_by(df: DataFrame, requester: object, owner: str = "owner") -> DataFrame:
    return df.filter(F.col(owner) == F.lit(requester))


def without_blocked(df: DataFrame, blocked: Sequence[str] = BLOCKED_COLUMNS) -> DataFrame:
    drop = [c for c in df.columns if c.lower() in blocked]
    out = df.drop(*drop)
    for field in out.schema.fields:
        if field.dataType.typeName() == "map":
            out = out.withColumn(
                field.name, F.map_filter(field.name, lambda k, v: ~F.lower(k).isin(list(blocked)))
            )
    return out


# --- top n per user -----------------------------------------------------------------------------
def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).filter(F.col(rank) <= n)


def newest(df: DataFrame, ts: str, row_id: str, n: int, key: str = "user_id") -> DataFrame:
    return latest_per(df, [key], [F.col(ts).desc(), F.col(row_id).desc()], n)


# --- path joins ---------------------------------------------------------------------------------
def user_timeline(user: DataFrame, session: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """User to session, oldest first, with a running number (JN1, WIN1, PRJ3)."""
    rows = not_deleted(session).join(user.select("user_id"), "user_id")
    return sequenced(rows, ["user_id"], ["timestamp", "session_id"], slice_rows=slice_rows)


def session_history(session: DataFrame, n: int = 12) -> DataFrame:
    return newest(not_deleted(session), "timestamp", "session_id", n)


def with_links(fact: DataFrame, links: Sequence[str]) -> DataFrame:
    return fact.filter(F.col("rel_type").isin(*links))


def risk_progression(
    user: DataFrame, session: DataFrame, prediction: DataFrame, links: Sequence[str] = PREDICTION_LINKS
) -> DataFrame:
    """User to session to prediction (JN2)."""
    hops = session.select("session_id", "user_id").join(user.select("user_id"), "user_id")
    return with_links(prediction, links).drop("user_id").join(hops, "session_id").select(
        "user_id",
        F.col("session_id").alias("session"),
        "prediction_id",
        first_present("risk_probability", "risk_score").alias("risk"),
        "confidence",
        F.col("created_at").alias("ts"),
    )


def fact_evolution(session: DataFrame, fact: DataFrame, kind: str, measures: Sequence[str], links: Sequence[str]) -> DataFrame:
    """Session to emotion, symptom or behaviour over any of ``links``; one row per edge (JN3)."""
    return (
        with_links(fact, links)
        .drop("user_id")
        .join(session.select("session_id", "user_id"), "session_id")
        .select(
            "user_id",
            F.col(f"{kind}_id").alias("id"),
            first_present(f"{kind}_name", kind).alias(kind),
            *measures,
            F.col("timestamp").alias("ts"),
        )
    )


def older_evolution(session: DataFrame, fact: DataFrame, kind: str, measure: str, link: str) -> DataFrame:
    """Facts of the user's sessions over a single edge type, by their plain name only (JN19)."""
    rows = with_links(fact, (link,)).drop("user_id").join(session.select("session_id", "user_id"), "session_id")
    return rows.select("user_id", kind, measure, F.col("timestamp").alias("ts"))


def older_timeline(user: DataFrame, session: DataFrame) -> DataFrame:
    """All sessions of the known users, deleted ones included (JN19)."""
    return session.join(user.select("user_id"), "user_id").select("user_id", "session_id", "timestamp")


def older_risk_progression(user: DataFrame, session: DataFrame, prediction: DataFrame) -> DataFrame:
    """Scores under their older name only, null where a prediction has the newer one (JN19)."""
    hops = older_timeline(user, session).select("user_id", "session_id")
    return with_links(prediction, ("PREDICTED",)).drop("user_id").join(hops, "session_id").select("user_id", F.col("session_id").alias("session"), F.col("risk_score").alias("risk"), F.col("created_at").alias("ts"))


def older_high_risk(session: DataFrame, prediction: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Distinct (session, risk) at or above the threshold under the older name (JN19)."""
    rows = with_links(prediction, ("PREDICTED",)).filter(F.col("risk_score") >= threshold)
    return rows.join(session.select("session_id"), "session_id").select(F.col("session_id").alias("session"), F.col("risk_score").alias("risk")).distinct()


def behaviour_evolution(session: DataFrame, prediction: DataFrame, behaviour: DataFrame) -> DataFrame:
    """User to session to prediction to behaviour (JN4)."""
    hops = with_links(prediction, PREDICTION_LINKS).select("prediction_id", "session_id")
    return (
        with_links(behaviour, ("IDENTIFIED",))
        .drop("user_id")
        .withColumnRenamed("session_id", "prediction_id")
        .join(hops, "prediction_id")
        .join(session.select("session_id", "user_id"), "session_id")
        .select(
            "user_id",
            F.col("behaviour_id").alias("id"),
            first_present("behaviour_name", "behaviour").alias("behaviour"),
            "value",
            F.col("confidence").alias("conf"),
            F.col("timestamp").alias("ts"),
        )
    )


def risk_over_time(session: DataFrame, prediction: DataFrame, risk: DataFrame) -> DataFrame:
    """Prediction with its risk node where one exists (JN5)."""
    base = with_links(prediction, PREDICTION_LINKS).drop("user_id").join(
        session.select("session_id", "user_id", F.col("timestamp").alias("session_ts")), "session_id"
    )
    return base.join(risk.select("prediction_id", "risk_level", "trend"), "prediction_id", "left").select(
        "user_id",
        F.col("session_id").alias("session"),
        "session_ts",
        "prediction_id",
        first_present("risk_probability", "risk_score").alias("risk"),
        "confidence",
        F.col("created_at").alias("ts"),
        "risk_level",
        F.col("trend"),
    )


def risk_timeline(session: DataFrame, prediction: DataFrame, risk: DataFrame) -> DataFrame:
    """Only predictions that carry a risk node (JN6)."""
    return risk_over_time(session, prediction, risk).filter("risk_level IS NOT NULL")


def feedback_summary(recommendation: DataFrame, feedback: DataFrame) -> DataFrame:
    """Follow-up actions per recommendation (JN7), counted before the join."""
    counts = feedback.groupBy("recommendation_id").agg(F.count("*").alias("interventions"))
    return recommendation.select(
        "user_id", "recommendation_id", "status", first_present("recommendation_type", "intervention_type").alias("type")
    ).join(counts, "recommendation_id")


def consecutive_sessions(session: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pairs (session i, session i+1) of each user with the days between (JN8, GR26)."""
    rows = sequenced(
        session,
        ["user_id"],
        ["timestamp", "session_id"],
        {"from_session": "session_id", "from_ts": "timestamp"},
        slice_rows=slice_rows,
    )
    return rows.filter("from_session IS NOT NULL").select(
        "user_id",
        (F.col("pos") - 1).alias("pair"),
        "from_session",
        F.col("session_id").alias("to_session"),
        "from_ts",
        F.col("timestamp").alias("to_ts"),
        elapsed_days(F.col("timestamp"), F.col("from_ts")).alias("gap_days"),
    )


def missed_sessions(session: DataFrame, gap_days: int = 7, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Consecutive sessions more than ``gap_days`` apart (WIN2)."""
    return consecutive_sessions(session, slice_rows).filter(F.col("gap_days") > gap_days)


def resolve_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Keep edges whose two ends exist (JN9); unmatched ones fall away as in a MATCH."""
    ids = node.select("node_id")
    return edge.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    )


def lookup_or(df: DataFrame, mapping: DataFrame, on: str, columns: dict[str, str | None]) -> DataFrame:
    """Left join with defaults for the unmatched (JN10)."""
    joined = df.join(mapping, on, "left")
    for name, default in columns.items():
        if default is not None:
            joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return joined


def collected_trend(evolution: DataFrame, name: str, measure: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The per-user list of a measure as ordered rows (JN18): nulls dropped, numbered by time."""
    rows = evolution.filter(F.col(measure).isNotNull())
    return sequenced(rows, ["user_id"], ["ts", "id"], slice_rows=slice_rows).select(
        "user_id", "pos", "id", *([name] if name != measure else []), measure, "ts"
    )


def recommendation_history(session: DataFrame, recommendation: DataFrame, n: int = 50) -> DataFrame:
    """Newest recommendations with legacy names resolved (TOP13, TOP2)."""
    rows = (
        with_links(recommendation, RECOMMENDATION_LINKS)
        .drop("user_id")
        .join(session.select("session_id", "user_id"), "session_id")
        .select(
            "user_id",
            F.col("recommendation_id").alias("id"),
            first_present("recommendation_type", "intervention_type").alias("type"),
            "priority",
            "status",
            "confidence",
            first_present("generated_at", "timestamp").alias("ts"),
        )
    )
    return newest(rows, "ts", "id", n)


def current_recommendations(session: DataFrame, recommendation: DataFrame, n: int = 10) -> DataFrame:
    """Pending or active recommendations, newest first (PRJ5)."""
    open_ones = recommendation.filter(F.col("status").isin("pending", "active"))
    return recommendation_history(session, open_ones, n)


# --- aggregates over paths ----------------------------------------------------------------------
def average_risk(score: DataFrame) -> DataFrame:
    return score.groupBy("user_id").agg(F.avg("risk").alias("average_risk"), F.count("risk").alias("n"))


def peak_risk_users(score: DataFrame, threshold: float = 0.7, n: int = 100) -> DataFrame:
    """Users by peak risk, the report's first ``n`` (AGG3)."""
    peaks = score.groupBy("user_id").agg(F.max("risk").alias("peak_risk")).filter(F.col("peak_risk") >= threshold)
    return peaks.orderBy(F.desc("peak_risk"), "user_id").limit(n)


def high_risk_sessions(prediction: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Risk at or above the threshold (PRJ6)."""
    risk = first_present("risk_probability", "risk_score")
    return prediction.select("session_id", "user_id", risk.alias("risk"), F.col("created_at").alias("ts")).filter(
        F.col("risk") >= threshold
    )


def legacy_high_risk(prediction: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Distinct (session, risk) over the legacy edge and the legacy column only (AGG4)."""
    return (
        with_links(prediction, ("PREDICTED",))
        .filter(F.col("risk_score") >= threshold)
        .select(F.col("session_id").alias("session"), F.col("risk_score").alias("risk"))
        .distinct()
    )


def improvement_trend(summary: DataFrame) -> DataFrame:
    """First against latest value; a tie counts as declining (AGG5)."""
    return summary.filter("n >= 2").select(
        "user_id",
        F.col("first").alias("first_risk"),
        F.col("last").alias("latest_risk"),
        (F.col("last") - F.col("first")).alias("delta"),
        F.when(F.col("last") < F.col("first"), "improving").otherwise("declining").alias("trend"),
    )


def decline_trend(summary: DataFrame) -> DataFrame:
    """Third from last against latest (AGG6)."""
    return summary.filter("n >= 3").select(
        "user_id",
        F.col("prev2").alias("risk_3_ago"),
        F.col("last").alias("latest"),
        (F.col("last") - F.col("prev2")).alias("recent_delta"),
        (F.col("last") > F.col("prev2")).alias("declining"),
    )


def sessions_since(session: DataFrame, days: int, as_of: Column | str | None = None) -> DataFrame:
    """Sessions in [as_of - days, as_of]; the newest session stands for now when none is given (DT1)."""
    if as_of is None:
        bound = session.agg(F.max("timestamp").alias("_as_of"))
        rows = session.crossJoin(F.broadcast(bound))
    else:
        rows = session.withColumn("_as_of", F.lit(as_of).cast("timestamp_ntz"))
    low = F.col("_as_of") - F.make_dt_interval(F.lit(days))
    return rows.filter((F.col("timestamp") >= low) & (F.col("timestamp") <= F.col("_as_of"))).drop("_as_of")


def timestamp_problems(df: DataFrame, column: str, row_id: str, as_of: str) -> DataFrame:
    """Texts that are no timestamps or lie in the future (DT2)."""
    parsed = F.try_to_timestamp(F.col(column))
    problem = F.when(parsed.isNull(), "invalid").when(parsed > F.lit(as_of).cast("timestamp"), "future")
    return df.select(row_id, problem.alias("problem")).filter("problem IS NOT NULL")


def clinical_trends(prediction: DataFrame, emotion: DataFrame, symptom: DataFrame) -> DataFrame:
    """Row counts per user over three facts; available from three predictions on (AGG20)."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.count("*").alias(name))

    out = counted(prediction, "risk_points").join(counted(emotion, "emotion_points"), "user_id", "full").join(
        counted(symptom, "symptom_points"), "user_id", "full"
    )
    names = ("risk_points", "emotion_points", "symptom_points")
    out = out.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("available", F.col("risk_points") >= 3)


def weekly_summary(score: DataFrame, days: int = 7) -> DataFrame:
    """Tumbling per-user summary (AGG19, STR5 as a batch)."""
    return (
        score.groupBy("user_id", F.window("ts", f"{days} days").alias("w"))
        .agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"))
        .select("user_id", F.col("w.start").alias("week_start"), "n", "mean_risk")
    )
