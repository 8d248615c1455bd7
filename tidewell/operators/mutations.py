"""Batch rewrites: upserts, appends, deletes, fan-out of nested records and snapshots.

Tables are rewritten as new DataFrames; write the result to a new location or partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.gates import edge_issues, entity_issues
from tidewell.operators.graph import reachable, sort_key
from tidewell.schemas import APPEND_ONLY_LABELS, ENTITY_DEFAULTS, ID_PREFIX, NATURAL_KEYS
from tidewell.session import dealt


def upsert(old: DataFrame, new: DataFrame, key: str, updated: str | None = None) -> DataFrame:
    """Merge by natural key: given properties win, absent (null) ones are kept (MUT1).

    With ``updated`` several rows per key are allowed and the latest non-null value of each column wins.
    """
    rest = [c for c in old.columns if c != key]
    if updated is None:
        n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") if c in new.columns else F.lit(None).alias(f"_n_{c}") for c in rest])
        return old.join(n, key, "full").select(key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in rest])
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(updated))).alias(c) for c in rest])


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only labels never overwrite (MUT2, MUT15)."""
    return old.unionByName(new, allowMissingColumns=True)


def route(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows to merge and rows to append (MUT3)."""
    fresh = F.col("label").isin(*APPEND_ONLY_LABELS)
    return entities.filter(~fresh), entities.filter(fresh)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent on type and ends: an existing edge stays (MUT4, MUT17)."""
    rows = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [c for c in old.columns if c not in ("src", "dst", "rel_type")]
    if not rest:
        return rows.select("src", "dst", "rel_type").distinct()
    kept = F.min_by(F.struct(*rest), F.struct("_age", *[F.col(c).cast("string") for c in rest]))
    return rows.groupBy("src", "dst", "rel_type").agg(kept.alias("_r")).select("src", "dst", "rel_type", "_r.*")


def with_defaults(df: DataFrame, label: str, key_parts: Sequence[str], prefix: str | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Fill default fields and derive a replayable id ``prefix_12hex`` (PRJ15)."""
    values = ENTITY_DEFAULTS[label] if defaults is None else defaults
    out = df
    for name, value in values.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    digest = F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key_parts]), 256), 1, 12)
    key = NATURAL_KEYS[label]
    made = F.concat(F.lit(f"{prefix or ID_PREFIX.get(label, label.lower())}_"), digest)
    return out.withColumn(key, F.coalesce(F.col(key).cast("string"), made) if key in df.columns else made)


def checksum(columns: Sequence[str]) -> Column:
    """First 16 hex digits of the sha256 of the sorted-key JSON (PRJ16)."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256), 1, 16)


def soft_delete(df: DataFrame, match: Column, at: str) -> DataFrame:
    """Stamp matching rows as deleted (MUT8)."""
    return df.withColumn("deleted_at", F.when(match, F.lit(at)).otherwise(F.col("deleted_at").cast("string")))


def erase(node: DataFrame, edge: DataFrame, roots: DataFrame, owner: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove roots and everything reachable over outgoing edges, at any depth, with all incident edges (MUT9).

    Nodes shared with other users go too; ``owner`` (``node_id``) restricts the removal to owned nodes. Edges are
    dealt by ``src`` once, for all steps and the removal.
    """
    edge = dealt(edge, "src")
    gone = reachable(edge, roots)
    if owner is not None:
        gone = gone.join(owner.select("node_id"), "node_id", "left_semi")
    return detach(node, edge, gone)


def detach(node: DataFrame, edge: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and their incident edges only (MUT14). ``gone`` has ``node_id``."""
    left = edge.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti")
    ends = gone.select(sort_key("node_id").alias("_id"))
    left = left.join(ends, sort_key(left["dst"]) == ends["_id"], "left_anti")
    return node.join(ends, sort_key(node["node_id"]) == ends["_id"], "left_anti"), left.select(*edge.columns)


def anonymise(user: DataFrame, match: Column, at: str) -> DataFrame:
    """Replace identifying fields by placeholders, keep the row for research (MUT10)."""
    def put(name: str, value: Column | str) -> Column:
        return F.when(match, value).otherwise(F.col(name) if name in user.columns else F.lit(None).cast("string"))

    return user.withColumns({
        "external_id": put("external_id", F.concat(F.lit("anon_"), F.col("uuid"))),
        "preferred_language": put("preferred_language", "redacted"),
        "country": put("country", "redacted"),
        "consent_status": put("consent_status", "anonymized"),
        "anonymized_at": put("anonymized_at", at),
    })


def withdraw_consent(user: DataFrame, match: Column, at: str) -> DataFrame:
    """Mark the consent as withdrawn (MUT10)."""
    return user.withColumns({
        "consent_status": F.when(match, "withdrawn").otherwise(F.col("consent_status")),
        "consent_withdrawn_at": F.when(match, at),
    })


def record_sessions(checkins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session rows plus ownership and previous-session edges (MUT5)."""
    session = checkins.select("session_id", "user_id", "timestamp", "quality_score")
    s = F.concat(F.lit("Session:"), F.col("session_id").cast("string"))
    links = F.array_compact(F.array(
        F.struct(F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("src"), s.alias("dst"), F.lit("HAS_SESSION").alias("rel_type")),
        F.when(F.col("previous_session_id").isNotNull(),
               F.struct(F.concat(F.lit("Session:"), F.col("previous_session_id").cast("string")).alias("src"), s.alias("dst"), F.lit("TEMPORALLY_PRECEDES").alias("rel_type"))),
    ))
    return session, checkins.select(F.explode(links).alias("e")).select("e.*")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def inference_rows(records: DataFrame) -> dict[str, DataFrame]:
    """Nested inference records fanned out into fact tables and their edges (MUT6).

    ``records``: ``user_id, session_id, risk_probability, confidence, ts`` and arrays ``emotions``,
    ``symptoms``, ``behaviours`` of (name, value) and ``recommendations`` of (type, priority). Facts
    carry both the session and the prediction id; ids derive from the session, so a replay agrees.
    """
    base = records.withColumn("prediction_id", F.concat(F.lit("pred_"), F.col("session_id").cast("string")))
    out = {
        "prediction": base.select("prediction_id", "session_id", "user_id", "risk_probability", "confidence", F.col("ts").alias("created_at")),
        "risk": base.select(F.concat(F.lit("risk_"), F.col("session_id").cast("string")).alias("risk_id"), "prediction_id", "session_id", "user_id",
                            risk_level(F.col("risk_probability")).alias("risk_level"), F.col("risk_probability").alias("risk_score")),
    }
    for kind in ("emotion", "symptom", "behaviour"):
        out[kind] = base.select("session_id", "prediction_id", "user_id", "ts", F.posexplode(f"{kind}s").alias("i", "f")).select(
            F.concat_ws("_", F.lit(kind), F.col("session_id").cast("string"), F.col("i").cast("string")).alias(f"{kind}_id"),
            "session_id", "prediction_id", "user_id", F.col("f.name").alias(f"{kind}_name"), F.col("f.value").alias("value"), F.col("ts").alias("timestamp"),
        )
    out["recommendation"] = base.select("session_id", "prediction_id", "user_id", "ts", F.posexplode("recommendations").alias("i", "f")).select(
        F.concat_ws("_", F.lit("rec"), F.col("session_id").cast("string"), F.col("i").cast("string")).alias("recommendation_id"),
        "session_id", "prediction_id", "user_id", F.col("f.type").alias("recommendation_type"), F.col("f.priority").alias("priority"), F.col("ts").alias("generated_at"),
    )
    session = F.concat(F.lit("Session:"), F.col("session_id").cast("string"))
    pred = F.concat(F.lit("Prediction:"), F.col("prediction_id"))
    edges = out["prediction"].select(session.alias("src"), pred.alias("dst"), F.lit("PRODUCED").alias("rel_type")).unionByName(
        out["risk"].select(pred.alias("src"), F.concat(F.lit("Risk:"), F.col("risk_id")).alias("dst"), F.lit("ESTIMATES").alias("rel_type"))
    )
    for kind, label, rel in (("emotion", "Emotion", "IDENTIFIED"), ("symptom", "Symptom", "IDENTIFIED"), ("behaviour", "Behaviour", "IDENTIFIED"), ("recommendation", "Recommendation", "GENERATED_REC")):
        edges = edges.unionByName(out[kind].select(pred.alias("src"), F.concat(F.lit(f"{label}:"), F.col(f"{kind}_id")).alias("dst"), F.lit(rel).alias("rel_type")))
    out["edge"] = edges
    return out


def weighted_edges(pairs: DataFrame, rel_type: str, weight: float = 0.5, confidence: float = 0.6, evidence: str = "clinical_rules") -> DataFrame:
    """Causal or semantic edges with weight and evidence (MUT7). ``pairs`` has ``src, dst``."""
    return pairs.select("src", "dst", F.lit(rel_type).alias("rel_type"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence_source"))


def graph_snapshots(levels: DataFrame, granularity: str = "daily") -> DataFrame:
    """Snapshot row per root: node count, checksum without clock, granularity (MUT12)."""
    return levels.select(
        "root", "node_count", F.lit(granularity).alias("granularity"),
        F.substring(F.sha2(F.concat_ws("|", "root", F.col("level1").cast("string"), F.col("level2").cast("string")), 256), 1, 16).alias("checksum"),
    )


def twin_snapshots(profile: DataFrame, score: DataFrame, granularity: str = "daily") -> DataFrame:
    """Profile facts and evolution score as a snapshot row (MUT13)."""
    rows = profile.select("user_id", "twin_id", "sessions").join(score.select("user_id", "overall_score", "maturity"), "user_id")
    return rows.select(
        "user_id", F.lit(granularity).alias("granularity"), "sessions", "overall_score", "maturity",
        F.substring(F.sha2(F.concat_ws("|", "twin_id", F.lit(granularity), F.col("sessions").cast("string")), 256), 1, 16).alias("snapshot_id"),
    )


def validated(entities: DataFrame, as_of: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the issues of the others; strict mode fails instead (MUT16)."""
    issues = entity_issues(entities, as_of).filter("severity = 'error'")
    bad = issues.select(F.col("participant_id").alias("uuid")).distinct()
    if strict:
        checked = issues.select(F.raise_error(F.concat(F.lit("invalid entity: "), F.col("message"))).alias("x"))
        checked.filter("x IS NULL").isEmpty()
    return entities.join(bad, "uuid", "left_anti"), issues


def validated_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    issues = edge_issues(edges)
    bad = issues.select(F.col("participant_id").alias("edge_id")).distinct()
    return edges.withColumn("edge_id", F.col("edge_id").cast("string")).join(bad, "edge_id", "left_anti"), issues


def missing_users(user: DataFrame, rows: DataFrame) -> DataFrame:
    """Users named by incoming rows but not stored yet (MUT16)."""
    return rows.select("user_id").distinct().join(user.select("user_id"), "user_id", "left_anti")


def backup_manifest(node: DataFrame, edge: DataFrame, version: str = "2.0.0") -> DataFrame:
    """Counts of a backup; raw media columns are refused (AGG27)."""
    raw = {"raw_media", "media_bytes"} & {c.lower() for c in node.columns}
    if raw:
        raise ValueError(f"raw media in backup: {sorted(raw)}")
    return node.agg(F.count("*").alias("node_count")).crossJoin(edge.agg(F.count("*").alias("edge_count"))).withColumn("version", F.lit(version))


def mark_validated(registry: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature registry rows with a new status (UDF4)."""
    return registry.withColumn("status", F.when(F.col("name").isin(*names), "validated").otherwise(F.col("status")))
