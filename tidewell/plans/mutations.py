"""Batch rewrites over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import graph as gr
from tidewell.operators import mutations as mu
from tidewell.operators import profiles as pf
from tidewell.operators.ordered import sequenced
from tidewell.plans.gates import ENT, EU, entities
from tidewell.plans.graphs import USERS
from tidewell.plans.profiles import EVO, V, flat_twin
from tidewell.plans.registry import add


def old_users(t):
    return t.customer.selectExpr("c_custkey AS user_id", "c_name AS external_id", "c_mktsegment AS preferred_language", "'granted' AS consent_status", "'standard' AS privacy_mode", "true AS cloud_enabled", "true AS edge_enabled")


def new_users(t):
    return t.orders.groupBy((F.col("o_custkey") + 500).alias("user_id")).agg(F.max("o_orderstatus").alias("preferred_language"), F.expr("CAST(NULL AS STRING) AS external_id"))


add("MUT1_upsert", lambda t: mu.upsert(old_users(t).select("user_id", "external_id", "preferred_language"), new_users(t), "user_id"),
    "SELECT coalesce(o.user_id, n.user_id) AS user_id, external_id, coalesce(n.l, o.l) AS preferred_language FROM (SELECT c_custkey AS user_id, c_name AS external_id, c_mktsegment AS l FROM customer) o "
    "FULL JOIN (SELECT o_custkey + 500 AS user_id, max(o_orderstatus) AS l FROM orders GROUP BY 1) n ON n.user_id = o.user_id")
add("MUT1_upsert_latest", lambda t: mu.upsert(t.customer.selectExpr("c_custkey AS user_id", "c_mktsegment AS status", "CAST(-1 AS BIGINT) AS seq"), t.orders.selectExpr("o_custkey AS user_id", "IF(o_orderkey % 3 = 0, NULL, o_orderstatus) AS status", "o_orderkey AS seq"), "user_id", "seq"),
    "SELECT user_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, max(seq) AS seq FROM (SELECT c_custkey AS user_id, c_mktsegment AS status, -1 AS seq FROM customer UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, o_orderkey FROM orders) GROUP BY 1")
add("MUT2_append", lambda t: mu.append(t.emotion.selectExpr("emotion_id AS id", "emotion_name AS name"), t.symptom.selectExpr("symptom_id AS id")).groupBy("name").agg(F.count("*").alias("n")),
    "SELECT name, count(*) AS n FROM (SELECT emotion_name AS name FROM emotion UNION ALL SELECT NULL FROM symptom) GROUP BY 1", "emotion symptom")
add("MUT3_route", lambda t: mu.route(t.node)[1].select("node_id", F.lit("append").alias("way")).unionByName(mu.route(t.node)[0].select("node_id", F.lit("merge").alias("way"))),
    "SELECT node_id, CASE WHEN label IN ('Prediction', 'Symptom', 'Intervention') THEN 'append' ELSE 'merge' END AS way FROM node", "node")
add("MUT4_merge_edges", lambda t: mu.merge_edges(t.edge, t.edge.filter("rel_type = 'HAS_SESSION'").unionByName(t.edge.filter("rel_type = 'IDENTIFIED'").withColumn("rel_type", F.lit("INDICATES")))),
    "SELECT DISTINCT src, dst, rel_type FROM edge UNION SELECT src, dst, 'INDICATES' FROM edge WHERE rel_type = 'IDENTIFIED'", "edge")


def recorded(t):
    linked = sequenced(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"prev_key": "o_orderkey"})  # first sessions have no previous one
    rows = linked.selectExpr("o_orderkey AS session_id", "o_custkey AS user_id", "prev_key AS previous_session_id", "o_orderdate AS timestamp", "1.0D AS quality_score")
    return mu.record_sessions(rows)


LINKED = "(SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)"
add("MUT5_record_sessions", lambda t: recorded(t)[1],
    f"SELECT 'User:' || o_custkey AS src, 'Session:' || o_orderkey AS dst, 'HAS_SESSION' AS rel_type FROM {LINKED} UNION ALL SELECT 'Session:' || p, 'Session:' || o_orderkey, 'TEMPORALLY_PRECEDES' FROM {LINKED} WHERE p IS NOT NULL")


def nested(t):
    return t.checkin.selectExpr("user_id", "id AS session_id", "least(value / 200, 1D) AS risk_probability", "k / 100.0D AS confidence", "ts",
                                "transform(sequence(1, 1 + k % 2), i -> named_struct('name', event_type, 'value', k / 100.0D)) AS emotions",
                                "IF(k % 3 = 0, array(named_struct('name', event_type, 'value', k / 50.0D)), CAST(array() AS ARRAY<STRUCT<name STRING, value DOUBLE>>)) AS symptoms",
                                "array(named_struct('name', 'b', 'value', value)) AS behaviours", "array(named_struct('type', event_type, 'priority', k % 4)) AS recommendations")


add("MUT6_inference_edges", lambda t: mu.inference_rows(nested(t))["edge"].groupBy("rel_type", F.split("dst", ":")[0].alias("label")).agg(F.count("*").alias("n")),
    "SELECT 'PRODUCED' AS rel_type, 'Prediction' AS label, count(*) AS n FROM checkin UNION ALL SELECT 'ESTIMATES', 'Risk', count(*) FROM checkin UNION ALL SELECT 'IDENTIFIED', 'Emotion', CAST(sum(1 + k % 2) AS BIGINT) FROM checkin "
    "UNION ALL SELECT 'IDENTIFIED', 'Symptom', count(*) FROM checkin WHERE k % 3 = 0 UNION ALL SELECT 'IDENTIFIED', 'Behaviour', count(*) FROM checkin UNION ALL SELECT 'GENERATED_REC', 'Recommendation', count(*) FROM checkin", "checkin")
add("MUT6_inference_facts", lambda t: mu.inference_rows(nested(t))["risk"], "SELECT 'risk_' || id AS risk_id, 'pred_' || id AS prediction_id, id AS session_id, user_id, CASE WHEN least(value / 2e2, 1e0) >= 7e-1 THEN 'high' WHEN least(value / 2e2, 1e0) >= 4e-1 THEN 'medium' ELSE 'low' END AS risk_level, least(value / 2e2, 1e0) AS risk_score FROM checkin", "checkin")
add("MUT7_causal_edges", lambda t: mu.weighted_edges(t.edge.filter("rel_type = 'IDENTIFIED'").select("src", "dst"), "MAY_INFLUENCE"),
    "SELECT src, dst, 'MAY_INFLUENCE' AS rel_type, 5e-1 AS weight, 6e-1 AS confidence, 'clinical_rules' AS evidence_source FROM edge WHERE rel_type = 'IDENTIFIED'", "edge")
add("MUT8_soft_delete", lambda t: mu.soft_delete(t.user, F.col("user_id") % 3 == 0, "2025-01-01").select("user_id", "deleted_at"),
    "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '2025-01-01' ELSE deleted_at END AS deleted_at FROM usr", "usr")


def gone_users(t):
    return t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("User:"), F.col("c_custkey").cast("string")).alias("root"))


CUSTS = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"
GONE = (f"WITH RECURSIVE gone(id) AS (SELECT 'User:' || c_custkey FROM customer WHERE c_custkey IN ({CUSTS}) UNION SELECT e.dst FROM gone JOIN edge e ON e.src = gone.id) SELECT id FROM gone")
add("MUT9_erase_users", lambda t: mu.erase(t.node, t.edge, gone_users(t))[0],
    f"SELECT * FROM node WHERE node_id NOT IN ({GONE})", "node edge")
add("MUT9_erase_users_edges", lambda t: mu.erase(t.node, t.edge, gone_users(t))[1],
    f"SELECT * FROM edge WHERE src NOT IN ({GONE}) AND dst NOT IN ({GONE})", "edge")
add("MUT10_anonymise", lambda t: mu.withdraw_consent(mu.anonymise(old_users(t).withColumn("uuid", F.sha2("external_id", 256)), F.col("user_id") % 4 == 0, "2025-01-01"), F.col("user_id") % 5 == 0, "2025-01-02").select(
        "user_id", "external_id", "preferred_language", "consent_status", "country", "anonymized_at", "consent_withdrawn_at"),
    "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'anon_' || sha256(c_name) ELSE c_name END AS external_id, CASE WHEN c_custkey % 4 = 0 THEN 'redacted' ELSE c_mktsegment END AS preferred_language, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'withdrawn' WHEN c_custkey % 4 = 0 THEN 'anonymized' ELSE 'granted' END AS consent_status, CASE WHEN c_custkey % 4 = 0 THEN 'redacted' END AS country, "
    "CASE WHEN c_custkey % 4 = 0 THEN '2025-01-01' END AS anonymized_at, CASE WHEN c_custkey % 5 = 0 THEN '2025-01-02' END AS consent_withdrawn_at FROM customer")
LEV = f"SELECT root, count(DISTINCT a.dst) AS level1, count(DISTINCT b.dst) AS level2 FROM {USERS} r LEFT JOIN edge a ON a.src = root LEFT JOIN edge b ON b.src = a.dst GROUP BY 1"


def user_roots(t):
    return t.customer.select(F.concat(F.lit("User:"), F.col("c_custkey").cast("string")).alias("root"))


add("MUT12_graph_snapshots", lambda t: mu.graph_snapshots(gr.two_levels(t.edge, user_roots(t))),
    f"SELECT root, level1 + level2 AS node_count, 'daily' AS granularity, substr(sha256(root || '|' || level1 || '|' || level2), 1, 16) AS checksum FROM ({LEV})", "edge")
add("MUT13_twin_snapshots", lambda t: mu.twin_snapshots(flat_twin(t), pf.evolution_score(flat_twin(t))),
    f"SELECT e.user_id, 'daily' AS granularity, n AS sessions, overall_score, maturity, substr(sha256(substr(sha256('twin:' || e.user_id), 1, 16) || '|daily|' || n), 1, 16) AS snapshot_id FROM ({EVO}) e JOIN trend t ON t.user_id = e.user_id", V)
add("MUT14_detach_delete", lambda t: mu.detach(t.node, t.edge, t.part.filter("p_size < 10").select(F.concat(F.lit("Symptom:"), F.col("p_partkey").cast("string")).alias("node_id")))[1],
    "SELECT * FROM edge WHERE dst NOT IN (SELECT 'Symptom:' || p_partkey FROM part WHERE p_size < 10)", "edge")
add("MUT15_plain_creates", lambda t: mu.append(t.user.select("user_id", "external_id"), t.customer.selectExpr("c_custkey + 100000 AS user_id", "c_name AS external_id")).groupBy("external_id").agg(F.count("*").alias("n"), F.max("user_id").alias("newest")),
    "SELECT c_name AS external_id, count(*) * 2 AS n, max(c_custkey) + 100000 AS newest FROM customer GROUP BY 1")
add("MUT16_validated_write", lambda t: mu.validated(entities(t), "2025-01-01 00:00:00")[0].select("uuid", "label"),
    f"SELECT uuid, CASE WHEN k % 13 = 0 THEN 'Ghost' ELSE 'Emotion' END AS label FROM (SELECT {EU} AS uuid, k FROM checkin) WHERE uuid NOT IN (SELECT participant_id FROM ({ENT}))", "checkin")
add("MUT16_missing_users", lambda t: mu.missing_users(t.user, t.orders.select((F.col("o_custkey") + 700).alias("user_id"))),
    "SELECT DISTINCT o_custkey + 700 AS user_id FROM orders WHERE o_custkey + 700 NOT IN (SELECT c_custkey FROM customer)")
add("MUT17_session_links", lambda t: mu.merge_edges(t.edge.filter("rel_type = 'HAS_SESSION'"), t.orders.selectExpr("concat('User:', o_custkey) AS src", "concat('Session:', o_orderkey) AS dst", "'HAS_SESSION' AS rel_type")),
    "SELECT DISTINCT 'User:' || o_custkey AS src, 'Session:' || o_orderkey AS dst, 'HAS_SESSION' AS rel_type FROM orders")
add("AGG27_backup_manifest", lambda t: mu.backup_manifest(t.node, t.edge), "SELECT (SELECT count(*) FROM node) AS node_count, (SELECT count(*) FROM edge) AS edge_count, '2.0.0' AS version", "node edge")
add("PRJ15_entity_defaults", lambda t: mu.with_defaults(t.customer.selectExpr("c_name AS external_id", "IF(c_nationkey < 10, NULL, c_mktsegment) AS preferred_language"), "User", ["external_id"], "user").select("user_id", "external_id", "preferred_language", "timezone", "consent_status", "edge_enabled"),
    "SELECT 'user_' || substr(sha256(c_name), 1, 12) AS user_id, c_name AS external_id, CASE WHEN c_nationkey < 10 THEN 'en' ELSE c_mktsegment END AS preferred_language, 'UTC' AS timezone, 'granted' AS consent_status, true AS edge_enabled FROM customer")
add("PRJ16_checksum", lambda t: t.checkin.select("id", mu.checksum(["user_id", "event_type"]).alias("checksum")),
    """SELECT id, substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) AS checksum FROM checkin""", "checkin")
add("UDF4_feature_registry", lambda t: mu.mark_validated(t.part.selectExpr("concat(p_name, '#', p_partkey) AS name", "p_brand AS owner", "'draft' AS status"), ["x#1"]).withColumn("status", F.when(F.col("owner") == "Brand#11", "validated").otherwise(F.col("status"))),
    "SELECT p_name || '#' || p_partkey AS name, p_brand AS owner, CASE WHEN p_brand = 'Brand#11' THEN 'validated' ELSE 'draft' END AS status FROM part")
