"""Canonical check-in tables derived from the star-schema and event tables.

Each view exists twice: as a DataFrame (``Tables``) and as SQL text (``SQL_VIEWS``) for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.schemas import TABLE_DDL

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the given tables and the canonical views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        # A declared schema spares the job that reads the footers first.
        return self.spark.read.schema(TABLE_DDL[name]).parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        raise AttributeError(name)

    # --- check-ins -----------------------------------------------------------------------------
    @cached_property
    def checkin(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").select(
            F.col("event_id").alias("id"), "user_id", "ts", "event_type", "value", k.alias("k")
        )

    @cached_property
    def user(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("external_id"),
            F.col("c_mktsegment").alias("preferred_language"),
            F.when(F.col("c_custkey") % 50 == 49, F.lit("2024-02-01")).alias("deleted_at"),
        )

    @cached_property
    def session(self) -> DataFrame:
        return self.checkin.select(
            F.col("id").alias("session_id"),
            "user_id",
            F.col("ts").alias("timestamp"),
            F.least(F.col("value") / 200.0, F.lit(1.0)).alias("quality_score"),
            F.col("event_type").alias("language"),
            (F.col("k") % 2 == 0).alias("offline_mode"),
            (F.col("k") % 3 == 0).alias("edge_processing"),
            F.col("value").alias("duration"),
            F.when(F.col("k") % 10 == 0, F.col("ts")).alias("deleted_at"),
        )

    @cached_property
    def prediction(self) -> DataFrame:
        risk = F.least(F.col("value") / 200.0, F.lit(1.0))
        return self.checkin.select(
            F.col("id").alias("prediction_id"),
            F.col("id").alias("session_id"),
            "user_id",
            F.when(F.col("k") % 4 != 0, risk).alias("risk_probability"),
            F.when(F.col("k") % 4 == 0, risk).alias("risk_score"),
            (F.col("k") / 100.0).alias("confidence"),
            F.col("ts").alias("created_at"),
            F.when(F.col("k") % 3 == 0, F.lit("PREDICTED")).otherwise(F.lit("PRODUCED")).alias("rel_type"),
        )

    @cached_property
    def score(self) -> DataFrame:
        """The risk series: one row per prediction with the alias already resolved (PRJ2)."""
        return self.prediction.select(
            F.col("prediction_id").alias("id"),
            "user_id",
            F.col("created_at").alias("ts"),
            F.coalesce("risk_probability", "risk_score").alias("risk"),
            "confidence",
        )

    @cached_property
    def risk(self) -> DataFrame:
        """Risk nodes exist for the predictions whose value is at least 50."""
        return self.checkin.filter("value >= 50").select(
            F.col("id").alias("risk_id"),
            F.col("id").alias("prediction_id"),
            F.when(F.col("value") >= 140, "high").when(F.col("value") >= 80, "medium").otherwise("low").alias("risk_level"),
            F.when(F.col("k") % 2 == 0, "up").otherwise("down").alias("trend"),
        )

    def _fact(self, kind: str, name: str, measure: str, links: tuple[str, str]) -> DataFrame:
        k = F.col("k")
        return self.checkin.select(
            F.col("id").alias(f"{kind}_id"),
            F.col("id").alias("session_id"),
            "user_id",
            F.when(k % 7 != 0, F.col("event_type")).alias(f"{kind}_name"),
            F.when(k % 7 == 0, F.col("event_type")).alias(kind),
            (k / 100.0).alias(measure),
            F.least(F.col("value") / 200.0, F.lit(1.0)).alias("confidence"),
            F.col("ts").alias("timestamp"),
            F.when(k % 3 == 0, links[0]).when(k % 3 == 1, links[1]).otherwise("HAS_FEATURE").alias("rel_type"),
        )

    @cached_property
    def emotion(self) -> DataFrame:
        return self._fact("emotion", "emotion_name", "probability", ("EXPRESSES", "IDENTIFIED"))

    @cached_property
    def symptom(self) -> DataFrame:
        return self._fact("symptom", "symptom_name", "severity", ("INDICATES", "IDENTIFIED"))

    @cached_property
    def behaviour(self) -> DataFrame:
        return self._fact("behaviour", "behaviour_name", "value", ("IDENTIFIED", "IDENTIFIED"))

    @cached_property
    def recommendation(self) -> DataFrame:
        k = F.col("k")
        return self.checkin.filter(F.col("event_type").isin("click", "purchase", "signup")).select(
            F.col("id").alias("recommendation_id"),
            F.col("id").alias("session_id"),
            "user_id",
            F.when(k % 5 != 0, F.col("event_type")).alias("recommendation_type"),
            F.when(k % 5 == 0, F.col("event_type")).alias("intervention_type"),
            (k % 4).alias("priority"),
            F.when(k % 3 == 0, "pending").when(k % 3 == 1, "active").otherwise("completed").alias("status"),
            (k / 100.0).alias("confidence"),
            F.when(k % 2 == 0, F.col("ts")).alias("generated_at"),
            F.when(k % 2 != 0, F.col("ts")).alias("timestamp"),
            F.when(k % 3 == 2, "GENERATED_REC").otherwise("RECOMMENDS").alias("rel_type"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """Interventions that followed a recommendation (one to three per purchase)."""
        return self.checkin.filter("event_type = 'purchase'").select(
            F.col("id").alias("recommendation_id"),
            F.explode(F.sequence(F.lit(0), F.col("k") % 3)).alias("step"),
        )

    # --- dataset side --------------------------------------------------------------------------
    @cached_property
    def dataset_index(self) -> DataFrame:
        """Flat modality rows: one per conversation turn."""
        c = self.raw("conversations")
        return c.select(
            F.col("conv_id").cast("string").alias("participant_id"),
            F.col("conv_id").cast("string").alias("session_id"),
            F.when(F.col("conv_id") % 3 == 0, "dvlog").otherwise("daic_woz").alias("dataset"),
            F.when(F.col("role") == "user", "transcript")
            .when(F.col("role") == "assistant", "audio")
            .otherwise("facial_features")
            .alias("modality"),
            F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file_path"),
            F.when(F.col("conv_id") % 4 == 0, "depression")
            .when(F.col("conv_id") % 4 == 3, "unknown")
            .otherwise("normal")
            .alias("label"),
            F.when(F.col("conv_id") % 10 < 7, "train").when(F.col("conv_id") % 10 == 7, "dev")
            .when(F.col("conv_id") % 10 == 8, "test").alias("split"),
            F.when(F.col("conv_id") % 5 == 0, "ta").otherwise("en").alias("language"),
            (F.length("text") / 15.0).alias("audio_length"),
            F.length("text").alias("transcript_length"),
            ((F.col("conv_id") % 11) / 10.0).alias("quality_score"),
            ((F.col("turn") % 4) / 3.0).alias("sync_score"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Classifier outcomes: label, predicted class and probability of class 1."""
        return self.raw("labels").join(self.raw("documents"), "doc_id").select(
            "doc_id",
            F.when(F.col("doc_id") % 17 == 0, -1).otherwise(F.col("quality")).cast("long").alias("label"),
            (1 - F.col("toxic")).cast("long").alias("pred"),
            (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("score"),
            F.col("lang").alias("language"),
        )

    # --- property graph ------------------------------------------------------------------------
    @cached_property
    def node(self) -> DataFrame:
        def pick(table: str, key: str, label: str) -> DataFrame:
            return self.raw(table).select(
                F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("node_id"),
                F.lit(label).alias("label"),
            )

        line = self.raw("lineitem").select(
            F.concat_ws("", F.lit("Prediction:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("node_id"),
            F.lit("Prediction").alias("label"),
        )
        return (
            pick("customer", "c_custkey", "User")
            .unionAll(pick("orders", "o_orderkey", "Session"))
            .unionAll(line)
            .unionAll(pick("part", "p_partkey", "Symptom"))
            .unionAll(pick("supplier", "s_suppkey", "Intervention"))
        )

    @cached_property
    def order_links(self) -> DataFrame:
        from tidewell.operators.ordered import sequenced

        orders = self.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey")
        return sequenced(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"prev_key": "o_orderkey"}).filter(
            "prev_key IS NOT NULL"
        )

    @cached_property
    def edge(self) -> DataFrame:
        def nid(label: str, *keys: str):
            parts = [F.col(k).cast("string") for k in keys]
            return F.concat(F.lit(label + ":"), F.concat_ws("-", *parts))

        owns = self.raw("orders").select(
            nid("User", "o_custkey").alias("src"), nid("Session", "o_orderkey").alias("dst"), F.lit("HAS_SESSION").alias("rel_type")
        )
        line = self.raw("lineitem")
        made = line.select(
            nid("Session", "l_orderkey").alias("src"), nid("Prediction", "l_orderkey", "l_linenumber").alias("dst"), F.lit("PRODUCED").alias("rel_type")
        )
        found = line.select(
            nid("Prediction", "l_orderkey", "l_linenumber").alias("src"), nid("Symptom", "l_partkey").alias("dst"), F.lit("IDENTIFIED").alias("rel_type")
        )
        chain = self.order_links.select(
            nid("Session", "prev_key").alias("src"), nid("Session", "o_orderkey").alias("dst"), F.lit("TEMPORALLY_PRECEDES").alias("rel_type")
        )
        return owns.unionAll(made).unionAll(found).unionAll(chain)


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _fact_sql(kind: str, measure: str, links: tuple[str, str]) -> str:
    return (
        f"SELECT id AS {kind}_id, id AS session_id, user_id, "
        f"CASE WHEN k % 7 <> 0 THEN event_type END AS {kind}_name, "
        f"CASE WHEN k % 7 = 0 THEN event_type END AS {kind}, k / 1e2 AS {measure}, "
        "least(value / 2e2, 1e0) AS confidence, ts AS timestamp, "
        f"CASE WHEN k % 3 = 0 THEN '{links[0]}' WHEN k % 3 = 1 THEN '{links[1]}' ELSE 'HAS_FEATURE' END AS rel_type "
        "FROM checkin"
    )


SQL_VIEWS: dict[str, str] = {
    "checkin": f"SELECT event_id AS id, user_id, ts, event_type, value, {_K} AS k FROM events",
    "usr": "SELECT c_custkey AS user_id, c_name AS external_id, c_mktsegment AS preferred_language, "
    "CASE WHEN c_custkey % 50 = 49 THEN '2024-02-01' END AS deleted_at FROM customer",
    "session": "SELECT id AS session_id, user_id, ts AS timestamp, least(value / 2e2, 1e0) AS quality_score, "
    "event_type AS language, k % 2 = 0 AS offline_mode, k % 3 = 0 AS edge_processing, value AS duration, "
    "CASE WHEN k % 10 = 0 THEN ts END AS deleted_at FROM checkin",
    "prediction": "SELECT id AS prediction_id, id AS session_id, user_id, "
    "CASE WHEN k % 4 <> 0 THEN least(value / 2e2, 1e0) END AS risk_probability, "
    "CASE WHEN k % 4 = 0 THEN least(value / 2e2, 1e0) END AS risk_score, k / 1e2 AS confidence, ts AS created_at, "
    "CASE WHEN k % 3 = 0 THEN 'PREDICTED' ELSE 'PRODUCED' END AS rel_type FROM checkin",
    "score": "SELECT prediction_id AS id, user_id, created_at AS ts, coalesce(risk_probability, risk_score) AS risk, "
    "confidence FROM prediction",
    "risk": "SELECT id AS risk_id, id AS prediction_id, CASE WHEN value >= 140 THEN 'high' WHEN value >= 80 THEN 'medium' "
    "ELSE 'low' END AS risk_level, CASE WHEN k % 2 = 0 THEN 'up' ELSE 'down' END AS trend FROM checkin WHERE value >= 50",
    "emotion": _fact_sql("emotion", "probability", ("EXPRESSES", "IDENTIFIED")),
    "symptom": _fact_sql("symptom", "severity", ("INDICATES", "IDENTIFIED")),
    "behaviour": _fact_sql("behaviour", "value", ("IDENTIFIED", "IDENTIFIED")),
    "recommendation": "SELECT id AS recommendation_id, id AS session_id, user_id, "
    "CASE WHEN k % 5 <> 0 THEN event_type END AS recommendation_type, "
    "CASE WHEN k % 5 = 0 THEN event_type END AS intervention_type, k % 4 AS priority, "
    "CASE WHEN k % 3 = 0 THEN 'pending' WHEN k % 3 = 1 THEN 'active' ELSE 'completed' END AS status, "
    "k / 1e2 AS confidence, CASE WHEN k % 2 = 0 THEN ts END AS generated_at, "
    "CASE WHEN k % 2 <> 0 THEN ts END AS timestamp, "
    "CASE WHEN k % 3 = 2 THEN 'GENERATED_REC' ELSE 'RECOMMENDS' END AS rel_type "
    "FROM checkin WHERE event_type IN ('click', 'purchase', 'signup')",
    "feedback": "SELECT id AS recommendation_id, unnest(range(0, k % 3 + 1)) AS step FROM checkin WHERE event_type = 'purchase'",
    "dataset_index": "SELECT CAST(conv_id AS VARCHAR) AS participant_id, CAST(conv_id AS VARCHAR) AS session_id, "
    "CASE WHEN conv_id % 3 = 0 THEN 'dvlog' ELSE 'daic_woz' END AS dataset, "
    "CASE WHEN role = 'user' THEN 'transcript' WHEN role = 'assistant' THEN 'audio' ELSE 'facial_features' END AS modality, "
    "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS file_path, "
    "CASE WHEN conv_id % 4 = 0 THEN 'depression' WHEN conv_id % 4 = 3 THEN 'unknown' ELSE 'normal' END AS label, "
    "CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 = 7 THEN 'dev' WHEN conv_id % 10 = 8 THEN 'test' END AS split, "
    "CASE WHEN conv_id % 5 = 0 THEN 'ta' ELSE 'en' END AS language, length(text) / 15e0 AS audio_length, "
    "length(text) AS transcript_length, (conv_id % 11) / 1e1 AS quality_score, (turn % 4) / 3e0 AS sync_score FROM conversations",
    "scored": "SELECT l.doc_id, CASE WHEN l.doc_id % 17 = 0 THEN -1 ELSE quality END AS label, 1 - toxic AS pred, "
    "least(n_chars, 4000) / 4e3 AS score, lang AS language FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "node": "SELECT 'User:' || c_custkey AS node_id, 'User' AS label FROM customer UNION ALL "
    "SELECT 'Session:' || o_orderkey, 'Session' FROM orders UNION ALL "
    "SELECT 'Prediction:' || l_orderkey || '-' || l_linenumber, 'Prediction' FROM lineitem UNION ALL "
    "SELECT 'Symptom:' || p_partkey, 'Symptom' FROM part UNION ALL "
    "SELECT 'Intervention:' || s_suppkey, 'Intervention' FROM supplier",
    "edge": "SELECT 'User:' || o_custkey AS src, 'Session:' || o_orderkey AS dst, 'HAS_SESSION' AS rel_type FROM orders UNION ALL "
    "SELECT 'Session:' || l_orderkey, 'Prediction:' || l_orderkey || '-' || l_linenumber, 'PRODUCED' FROM lineitem UNION ALL "
    "SELECT 'Prediction:' || l_orderkey || '-' || l_linenumber, 'Symptom:' || l_partkey, 'IDENTIFIED' FROM lineitem UNION ALL "
    "SELECT 'Session:' || prev_key, 'Session:' || o_orderkey, 'TEMPORALLY_PRECEDES' FROM (SELECT o_orderkey, "
    "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_key FROM orders) WHERE prev_key IS NOT NULL",
    # naive per-user risk series, the yardstick for the sliced operators
    "seq": "SELECT user_id, ts, id, risk, confidence, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, "
    "risk - lag(risk) OVER w AS d, risk - lag(risk, 2) OVER w AS d2, "
    "lag(risk) OVER w AS p1, lag(risk, 2) OVER w AS p2, lag(risk, 3) OVER w AS p3, "
    "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400e6 AS gap FROM score WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)",
    "trend": "SELECT user_id, max(n) AS n, max(CASE WHEN rn = 1 THEN risk END) AS first, max(CASE WHEN rn = n THEN risk END) AS last, "
    "max(CASE WHEN rn = n THEN p1 END) AS prev, max(CASE WHEN rn = n THEN p2 END) AS prev2, max(CASE WHEN rn = n THEN p3 END) AS prev3, "
    "avg(risk) AS mean, min(risk) AS low, max(risk) AS peak, coalesce(regr_slope(risk, rn), 0e0) AS slope, "
    "coalesce(var_samp(risk), 0e0) AS var, coalesce(stddev_pop(risk), 0e0) AS sd_pop, "
    "sum(CASE WHEN rn = 1 THEN power(7e-1, n - 1) * risk ELSE 3e-1 * power(7e-1, n - rn) * risk END) AS ema, "
    "min(d) AS delta_low, max(d) AS delta_peak, max(floor(gap)) AS gap_max_days, count(CASE WHEN floor(gap) > 7 THEN 1 END) AS n_gaps, "
    "count(CASE WHEN risk >= 7e-1 THEN 1 END) AS n_high, avg(CASE WHEN rn < n THEN risk END) AS base_mean, "
    "stddev_samp(CASE WHEN rn < n THEN risk END) AS base_sd, max(CASE WHEN rn = n THEN confidence END) AS last_confidence, "
    "min(ts) AS first_ts, max(ts) AS last_ts FROM seq GROUP BY user_id",
}
_NEEDS = {
    "usr": [], "checkin": [], "dataset_index": [], "scored": [], "node": [], "edge": [],
    "score": ["prediction"], "seq": ["score"], "trend": ["seq"],
}


def with_views(names: str, body: str) -> str:
    """``WITH`` clause for the views named (space separated) and their inputs, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, ["checkin"]):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    clauses = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in order)
    return f"WITH {clauses} {body}" if order else body


def more_views(sql: str, extra: dict[str, str], body: str) -> str:
    """Append further CTEs to a ``with_views`` text that ends in an empty body."""
    clauses = ", ".join(f"{name} AS ({text})" for name, text in extra.items())
    head = sql.strip()
    return f"{head}, {clauses} {body}" if head else f"WITH {clauses} {body}"
