"""Per-user score series: trends, states, anomalies, forecasts and alerts.

All of them read the one-row-per-user result of ``ordered.series_summary``, so twenty statistics
share one shuffle of the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import clamp, exact_mean, micros, r4
from tidewell.operators.ordered import SLICE_ROWS, sequenced, series_summary

SEVERITY = {
    "risk_increase": "medium",
    "repeated_high_risk": "high",
    "rapid_deterioration": "high",
    "missing_checkins": "low",
    "persistent_negative_mood": "medium",
    "low_confidence": "low",
}


def _s(name: str) -> Column:
    return F.col(name)


def variance(summary_m2: str = "m2", n: str = "n") -> Column:
    """Sample variance, 0 below two points."""
    return F.when(_s(n) > 1, _s(summary_m2) / (_s(n) - 1)).otherwise(0.0)


def acceleration() -> Column:
    return F.when(_s("n") >= 3, (_s("last") - _s("prev")) - (_s("prev") - _s("prev2"))).otherwise(0.0)


def moving_average() -> Column:
    total = _s("last") + F.coalesce("prev", F.lit(0.0)) + F.coalesce("prev2", F.lit(0.0))
    return total / F.least(_s("n"), F.lit(3))


def interval_half_width(z: float = 1.96) -> Column:
    return F.lit(z) * F.sqrt(variance() / _s("n"))


def trend_record(summary: DataFrame, *more: Column) -> DataFrame:
    """Ten trend fields per user, rounded to four places (WIN9), and further columns of the summary."""
    half = interval_half_width()
    return summary.select(
        "user_id",
        r4("last").alias("current_risk"),
        r4("mean").alias("average_risk"),
        r4("peak").alias("peak_risk"),
        r4("low").alias("minimum_risk"),
        r4("slope").alias("slope"),
        r4(acceleration()).alias("acceleration"),
        r4(moving_average()).alias("moving_average"),
        r4("ema").alias("exponential_trend"),
        r4(_s("mean") - half).alias("ci_low"),
        r4(_s("mean") + half).alias("ci_high"),
        _s("n").alias("n_points"),
        *more,
    )


def temporal_state(
    missing: Column | None = None,
    sudden: float = 0.2,
    deterioration: float = 0.05,
    recovery: float = -0.15,
) -> Column:
    """State of a series from its *rounded* slope and mean (WIN10)."""
    slope, mean = r4("slope"), r4("mean")
    rising = F.when(
        (_s("n") >= 4) & (_s("last") > mean) & (_s("prev3") < mean), "relapse"
    ).otherwise("deterioration")
    falling = F.when(_s("last") < mean, "recovery").otherwise("improvement")
    missing = F.lit(0) if missing is None else missing
    return (
        F.when(_s("n") < 2, "insufficient_data")
        .when(missing > 0, "missing_checkins")
        .when(F.abs(_s("last") - _s("prev")) >= sudden, "sudden_change")
        .when(slope >= deterioration, rising)
        .when(slope <= recovery, falling)
        .otherwise("stable")
    )


def state_confidence() -> Column:
    return F.when(_s("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.abs(r4("slope")) + 0.5))


def long_term_direction() -> Column:
    slope = r4("slope")
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat")


def temporal_states(summary: DataFrame, missing: Column | None = None) -> DataFrame:
    return summary.select(
        "user_id",
        temporal_state(missing).alias("state"),
        state_confidence().alias("confidence"),
        long_term_direction().alias("long_term_trend"),
    )


def emotion_stability(fact: DataFrame, measure: str = "probability") -> DataFrame:
    """Population spread of a measure and 1 minus it (WIN12)."""
    sd = F.when(F.count(measure) >= 2, F.stddev_pop(measure)).otherwise(0.0)
    return fact.groupBy("user_id").agg(
        r4(F.greatest(F.lit(0.0), 1 - sd)).alias("stability"), r4(sd).alias("volatility"), r4(F.avg(measure)).alias("mean")
    )


# --- anomalies ----------------------------------------------------------------------------------
def baseline_sd() -> Column:
    """Sample deviation of all but the latest value; a constant history counts as 0.01."""
    sd = F.sqrt(_s("base_m2") / F.greatest(_s("n") - 2, F.lit(1)))
    return F.when(sd < 1e-9, 0.01).otherwise(sd)


def z_score() -> Column:
    return F.when(_s("n") >= 3, (_s("last") - _s("base_mean")) / baseline_sd())


def unexpected_increase(summary: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Latest value far above the earlier ones (WIN13)."""
    return summary.select(
        "user_id", r4(z_score()).alias("z_score"), _s("last").alias("latest"), r4("base_mean").alias("baseline_mean")
    ).filter(F.col("z_score") >= threshold)


def mood_shift(summary: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Last step of a measure at least ``threshold`` in either direction (WIN14)."""
    delta = _s("last") - _s("prev")
    return summary.filter(F.abs(delta) >= threshold).select(
        "user_id", r4(delta).alias("delta"), _s("prev").alias("from_value"), _s("last").alias("to_value")
    )


def missing_gaps(summary: DataFrame, threshold: int = 7) -> DataFrame:
    """Users with a gap above ``threshold`` days, and the longest one (WIN15)."""
    return summary.filter(_s("gap_max_days") > threshold).select(
        "user_id", _s("gap_max_days").alias("max_gap_days"), F.lit(threshold).cast("long").alias("threshold")
    )


def anomaly_scan(risk: DataFrame, emotion: DataFrame, gap_threshold: int = 7) -> DataFrame:
    """All anomaly kinds in one table (WIN16)."""
    def kind(df: DataFrame, name: str, value: str) -> DataFrame:
        return df.select("user_id", F.lit(name).alias("type"), F.col(value).cast("double").alias("value"))

    return (
        kind(unexpected_increase(risk), "unexpected_risk_increase", "z_score")
        .unionByName(kind(mood_shift(emotion), "sudden_mood_shift", "delta"))
        .unionByName(kind(missing_gaps(risk, gap_threshold), "missing_sessions", "max_gap_days"))
    )


def step_patterns(summary: DataFrame, up: float = 0.05, down: float = -0.05) -> DataFrame:
    """Every step up, or every step down, by at least a threshold (WIN17)."""
    enough = _s("n") >= 3
    return summary.select(
        "user_id",
        (enough & (_s("delta_low") >= up)).alias("escalation"),
        (enough & (_s("delta_peak") <= down)).alias("recovery"),
    )


def recovery_timeline(score: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Change from each score to the next with its direction (WIN18)."""
    rows = sequenced(
        score.filter("risk IS NOT NULL"), ["user_id"], ["ts", "id"], {"before": "risk"}, slice_rows=slice_rows
    )
    delta = F.col("risk") - F.col("before")
    return rows.filter("before IS NOT NULL").select(
        "user_id",
        "id",
        "ts",
        r4(delta).alias("risk_delta"),
        F.when(delta < 0, "improving").when(delta > 0, "declining").otherwise("stable").alias("direction"),
    )


def simple_trend(summary: DataFrame, band: float = 0.1) -> DataFrame:
    """First against last with a dead band (WIN19)."""
    delta = _s("last") - _s("first")
    return summary.filter("n >= 2").select(
        "user_id",
        F.when(delta > band, "increasing").when(delta < -band, "decreasing").otherwise("stable").alias("trend"),
        _s("n").alias("points"),
    )


def history_reasoning(summary: DataFrame, expected: int | None = None) -> DataFrame:
    """Trend with a range test, sudden change and missed check-ins (WIN20)."""
    delta = _s("last") - _s("first")
    trend = (
        F.when(_s("n") < 2, "insufficient_history")
        .when(delta > 0.15, "risk_increasing")
        .when(delta < -0.15, "risk_decreasing")
        .when(_s("peak") - _s("low") < 0.05, "stable")
        .otherwise("fluctuating")
    )
    return summary.select(
        "user_id",
        trend.alias("trend"),
        F.coalesce(F.abs(_s("last") - _s("prev")) >= 0.25, F.lit(False)).alias("sudden_change"),
        (trend == "risk_decreasing").alias("recovery"),
        (trend == "risk_increasing").alias("deterioration"),
        _s("last").alias("latest_risk"),
        (_s("n") < F.lit(expected or 0)).alias("missing_checkins"),
    )


# --- forecasts ----------------------------------------------------------------------------------
def forecast(days: int) -> Column:
    """Last value plus the unrounded slope carried forward, kept in [0, 1] (WIN21)."""
    ahead = _s("last") + _s("slope") * F.lit(days / 30) * _s("n")
    return F.when(_s("n") < 2, _s("last")).otherwise(r4(clamp(ahead)))


def recovery_probability() -> Column:
    slope = r4("slope")
    return (
        F.when(_s("n") < 2, 0.5)
        .when(slope < -0.05, r4(F.least(F.lit(1.0), F.lit(0.6) + F.abs(slope))))
        .otherwise(r4(F.greatest(F.lit(0.0), F.lit(0.4) - slope)))
    )


def relapse_probability() -> Column:
    slope = r4("slope")
    return (
        F.when(_s("n") < 3, 0.2)
        .when((slope > 0.05) & (_s("last") > _s("mean")), r4(F.least(F.lit(1.0), F.lit(0.5) + slope)))
        .otherwise(r4(F.greatest(F.lit(0.0), F.lit(0.3) + slope * 0.5)))
    )


def risk_evolution(summary: DataFrame, min_sessions: int = 3) -> DataFrame:
    """Current state, forecasts and probabilities per user (WIN23)."""
    return summary.select(
        "user_id",
        r4("last").alias("current_risk"),
        forecast(7).alias("forecast_7d"),
        forecast(30).alias("forecast_30d"),
        forecast(90).alias("forecast_90d"),
        recovery_probability().alias("recovery_probability"),
        relapse_probability().alias("relapse_probability"),
        F.least(F.lit(1.0), _s("n") / 10.0).alias("prediction_confidence"),
        temporal_state().alias("temporal_state"),
        (_s("n") >= min_sessions).alias("sufficient_data"),
    )


# --- order and time features ---------------------------------------------------------------------
def order_violations(df: DataFrame, arrival: str = "id", ts: str = "ts", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows whose time lies before the row that arrived just before them (WIN24).

    Of rows with one arrival number none is known to be the earlier; they follow each other by time.
    """
    rows = sequenced(df, ["user_id"], [arrival, ts], {"before": ts}, slice_rows=slice_rows)
    return rows.filter(F.col(ts) < F.col("before")).select("user_id", F.col("pos").alias("position"), arrival, ts, "before")


def time_features(df: DataFrame, ts: str = "ts", row_id: str = "id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Scales of the time since the previous row (WIN26); a first row has 0."""
    rows = sequenced(df, ["user_id"], [ts, row_id], {"before": ts}, slice_rows=slice_rows)
    delta = F.coalesce((micros(ts) - micros("before")) / F.lit(1e6), F.lit(0.0))
    days = delta / 86400.0
    return rows.select(
        "user_id",
        row_id,
        (delta / 60.0).alias("minutes"),
        (delta / 3600.0).alias("hours"),
        days.alias("days"),
        (days / 7.0).alias("weeks"),
        (days / 30.0).alias("months"),
        F.sin(days * F.lit(3.141592653589793)).alias("relative"),
    )


def temporal_attention(session: DataFrame, last: int = 10) -> DataFrame:
    """Weights (i+1)/n over a user's last sessions, n being all of them (WIN25)."""
    from tidewell.operators.timelines import newest

    totals = session.groupBy("user_id").agg(F.count("*").alias("_n"))
    recent = newest(session.select("user_id", "session_id", "timestamp"), "timestamp", "session_id", last)
    kept = F.least(F.col("_n"), F.lit(last))
    return recent.join(totals, "user_id").select(
        "user_id", "session_id", ((kept - F.col("rank") + 1) / F.greatest(F.col("_n"), F.lit(1))).alias("weight")
    )


# --- alerts -------------------------------------------------------------------------------------
def alert_inputs(
    score: DataFrame, mood: DataFrame | None = None, gap_days: int = 7, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Series summary plus latest confidence and negative mood, one row per user."""
    summary = series_summary(score, gap_days=gap_days, slice_rows=slice_rows)
    latest = score.groupBy("user_id").agg(F.max_by("confidence", F.struct("ts", "id")).alias("last_confidence"))
    out = summary.join(latest, "user_id", "left")
    if mood is not None:
        moods = mood.groupBy("user_id").agg(F.count("probability").alias("mood_n"), exact_mean("probability").alias("mood_mean"))
        out = out.join(moods, "user_id", "left")
    else:
        out = out.withColumn("mood_n", F.lit(0)).withColumn("mood_mean", F.lit(None).cast("double"))
    return out


def alert_conditions(
    jump: float = 0.15, high_count: int = 3, slope: float = 0.05, mood: float = 0.6, low_confidence: float = 0.5
) -> dict[str, tuple[Column, Column]]:
    """Alert type -> (condition, reported value) over ``alert_inputs`` rows (ALT1 to ALT6)."""
    step = _s("last") - _s("prev")
    return {
        "risk_increase": (step >= jump, step),
        "repeated_high_risk": (_s("n_high") >= high_count, _s("n_high").cast("double")),
        "rapid_deterioration": (r4("slope") >= slope, r4("slope")),
        "missing_checkins": (_s("n_gaps") > 0, _s("n_gaps").cast("double")),
        "persistent_negative_mood": ((_s("mood_n") >= 3) & (_s("mood_mean") >= mood), _s("mood_mean")),
        "low_confidence": (_s("last_confidence") < low_confidence, _s("last_confidence")),
    }


def alerts(inputs: DataFrame, **thresholds) -> DataFrame:
    """Active alerts, one row each (ALT7)."""
    made = [
        F.when(
            condition,
            F.struct(
                F.lit(kind).alias("alert_type"), F.lit(SEVERITY[kind]).alias("severity"), value.alias("value")
            ),
        )
        for kind, (condition, value) in alert_conditions(**thresholds).items()
    ]
    return inputs.select("user_id", F.explode(F.array_compact(F.array(*made))).alias("a")).select(
        "user_id", "a.alert_type", "a.severity", "a.value", F.lit("active").alias("status")
    )


