"""Validation gates: every gate maps tables to issue rows; a roll-up turns issues into a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.quality import category, participant_quality
from tidewell.operators.dataset import duplicates, split_leakage
from tidewell.schemas import (
    ALLOWED_EDGES, FRAME_RATES, LABELS, NODE_LABELS, OTHER_EDGE_TYPES, REQUIRED_PROPERTIES, SPLITS, TEMPORAL_EDGES,
)

ISSUE = ("gate", "check", "severity", "message", "participant_id")


def issue(df: DataFrame, gate: str, check: str, severity: str, message: Column | str, participant: str | None = "participant_id") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    who = F.col(participant).cast("string") if participant else F.lit(None).cast("string")
    return df.select(
        F.lit(gate).alias("gate"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), text.alias("message"), who.alias("participant_id")
    )


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_issues(df: DataFrame, gate: str, rules: list[tuple[str, str, Column, Column | str]], participant: str = "participant_id") -> DataFrame:
    """Several row rules in one pass: each is (check, severity, condition, message)."""
    made = [
        F.when(cond, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                              (F.lit(msg) if isinstance(msg, str) else msg).alias("message")))
        for check, severity, cond, msg in rules
    ]
    return df.select(F.col(participant).cast("string").alias("participant_id"), F.explode(F.array_compact(F.array(*made))).alias("i")).select(
        F.lit(gate).alias("gate"), "i.check", "i.severity", "i.message", "participant_id"
    )


def repeated(df: DataFrame, count: str = "n", chunk: int = 100_000) -> DataFrame:
    """Each row as often as its ``count`` says, in chunks, so that a large count does not burden one task."""
    rows = df.filter(F.col(count) > 0).withColumn("_c", F.explode(F.expr(f"sequence(0, ({count} - 1) DIV {chunk})"))).repartition(*df.columns, "_c")
    return rows.withColumn("_i", F.explode(F.expr(f"sequence(_c * {chunk} + 1, least({count}, (_c + 1) * {chunk}))"))).drop("_c", "_i")


def integrity(index: DataFrame, listing: DataFrame, allowed: dict[str, tuple[str, ...]], min_size: int = 1) -> DataFrame:
    """Path given, file there, size, repeated path, extension (DQ1).

    ``listing`` has ``file_path, size``. A repeated path is reported once per row beyond the first,
    counted by path so no row order is needed.
    """
    rows = index.join(listing, "file_path", "left")
    ext = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    extension_ok = F.lit(True)
    for modality, endings in allowed.items():
        extension_ok = F.when(F.col("modality") == modality, ext.isin(*endings)).otherwise(extension_ok)
    blank = F.coalesce("file_path", F.lit("")) == ""
    there = F.col("size").isNotNull()
    name = F.element_at(F.split("file_path", "/"), -1)
    single = row_issues(rows, "integrity", [
        ("existence", "error", blank, "Missing file path"),
        ("existence", "error", ~blank & ~there, F.concat(F.lit("File missing: "), name)),
        ("size", "error", there & (F.col("size") < min_size), F.concat(F.lit("Too small ("), F.col("size").cast("string"), F.lit(" bytes)"))),
        ("extension", "warning", there & ~extension_ok, F.concat(F.lit("Unexpected extension "), ext)),
    ])
    twice = rows.filter(there & ~blank).groupBy("file_path").agg(F.count("*").alias("n"), F.min("participant_id").alias("participant_id"))
    twice = repeated(twice.withColumn("n", F.col("n") - 1))
    return single.unionByName(issue(twice, "integrity", "duplicate", "warning", F.concat(F.lit("Duplicate path: "), name)))


def consistency(sessions: DataFrame) -> DataFrame:
    """Columns, duplicate keys and vocabularies (DQ2)."""
    spark = sessions.sparkSession
    required = ("participant_id", "session_id", "dataset", "split", "label")
    missing = [c for c in required if c not in sessions.columns]
    parts = []
    if missing:
        rows = [("consistency", "metadata", "error", f"Missing column: {c}", None) for c in missing]
        parts.append(spark.createDataFrame(rows, "gate STRING, check STRING, severity STRING, message STRING, participant_id STRING"))
    if "session_id" not in missing and "participant_id" not in missing:
        dup = duplicates(sessions, ["participant_id", "session_id"]).select("participant_id").distinct()
        parts.append(issue(dup, "consistency", "duplicate_session", "error", "Conflicting session records"))
    checks = []
    if "split" not in missing:
        checks.append(("split", "warning", ~F.coalesce("split", F.lit("")).isin(*SPLITS), "Non-standard split"))
    if "label" not in missing:
        checks.append(("label", "warning", ~F.lower(F.coalesce("label", F.lit(""))).isin(*LABELS), "Non-standard label"))
    if checks:
        parts.append(row_issues(sessions, "consistency", checks))
    return union(parts)


def quality_scores(sessions: DataFrame) -> DataFrame:
    """Component scores and the band per session (MTH12, PRJ10)."""
    parts = participant_quality(
        F.col("quality_score"), F.col("sync_score"), F.col("has_audio"), F.col("has_visual"), F.col("has_transcript"), F.col("participant_id")
    )
    return sessions.select("participant_id", "session_id", *[c.alias(n) for n, c in parts.items()]).withColumn("category", category(F.col("overall")))


def quality(sessions: DataFrame, reject_below: float = 0.30) -> DataFrame:
    low = quality_scores(sessions).filter(F.col("overall") < reject_below)
    return issue(low, "quality", "quality_reject", "warning", "Quality below threshold")


def quality_verdict(sessions: DataFrame) -> DataFrame:
    """Warning once half of the sessions fall into the lowest band (DQ3)."""
    return quality_scores(sessions).agg(F.count_if(F.col("category") == "rejected").alias("rejected"), F.count("*").alias("total")).withColumn(
        "status", F.when(F.col("rejected") < F.col("total") * 0.5, "passed").otherwise("warning")
    )


def leakage(sessions: DataFrame, index: DataFrame) -> DataFrame:
    """Participants in several splits, repeated files, repeated sessions (DQ7)."""
    across = split_leakage(sessions)
    files = duplicates(index, ["file_path"])
    again = duplicates(sessions, ["participant_id", "session_id"]).select("participant_id").distinct()
    return union([
        issue(across, "leakage", "split_leakage", "error", F.concat(F.lit("Participant in multiple splits: "), F.col("splits").cast("string"))),
        issue(files, "leakage", "duplicate_file", "error", F.concat(F.lit("Duplicated file: "), F.element_at(F.split("file_path", "/"), -1)), None),
        issue(again, "leakage", "duplicate_session", "error", "Duplicated session"),
    ])


def vectors(features: DataFrame, gate: str = "features") -> DataFrame:
    """NaN and infinity per vector; ``features`` has ``participant_id, modality, v`` (DQ4)."""
    return row_issues(features.filter("v IS NOT NULL"), gate, [
        ("nan", "error", F.exists("v", lambda x: F.isnan(x)), F.concat(F.lit("NaN in "), F.col("modality"))),
        ("inf", "error", F.exists("v", lambda x: F.abs(x) == float("inf")), F.concat(F.lit("Inf in "), F.col("modality"))),
    ])


def embedding_digest(v: str = "v") -> Column:
    return F.sha2(F.to_json(F.struct(v)), 256)


def embeddings(features: DataFrame) -> DataFrame:
    """Empty vectors, repeated contents beyond the first, missing version (DQ5, SET6).

    ``features`` has ``participant_id, v, model_version``. Repeats are counted per digest.
    """
    rows = features.withColumn("_d", embedding_digest())
    single = row_issues(rows, "embeddings", [
        ("empty_embedding", "error", F.size("v") == 0, "Empty embedding"),
        ("metadata", "warning", F.col("model_version").isNull(), "Missing version in sidecar"),
    ])
    # of n equal vectors n - 1 are repeats, whosever they are: all but one row of the first participant
    each = rows.groupBy("_d", "participant_id").agg(F.count("*").alias("n"))
    first = each.groupBy("_d").agg(F.min("participant_id").alias("_first"))
    again = each.join(first, "_d").withColumn("n", F.col("n") - F.when(F.col("participant_id").eqNullSafe(F.col("_first")), 1).otherwise(0))
    again = repeated(again.select("_d", "participant_id", "n"))
    return single.unionByName(issue(again, "embeddings", "duplicate_embedding", "error", "Duplicate embedding checksum"))


def export_gate(exported: DataFrame, manifests: DataFrame, key: str = "participant_id") -> DataFrame:
    """Whether the manifest listing names each exported key; a missing manifest only warns (DQ8)."""
    listed = manifests.select(key).distinct().withColumn("_listed", F.lit(True))
    status = F.when(F.col("_listed"), "passed").otherwise("warning")
    return exported.select(key).distinct().join(listed, key, "left").select(key, F.lit("export").alias("gate"), status.alias("status"))


def roll_up(issues: DataFrame, soft: tuple[str, ...] = ("features", "embeddings"), gates: tuple[str, ...] = ()) -> DataFrame:
    """Status per gate: errors fail it, or only warn for the soft gates (DQ9, SNK11, SNK12)."""
    counted = issues.groupBy("gate").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"))
    if gates:
        every = issues.sparkSession.createDataFrame([(g,) for g in gates], "gate STRING")
        counted = every.join(counted, "gate", "left").fillna(0, ["issues", "errors"])
    status = F.when(F.col("errors") == 0, "passed").when(F.col("gate").isin(*soft), "warning").otherwise("failed")
    return counted.withColumn("status", status)


def approval(gates: DataFrame) -> DataFrame:
    return gates.agg(F.count("*").alias("gates"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("approved", F.col("failed") == 0)


# --- entities and edges -------------------------------------------------------------------------
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def entity_issues(entities: DataFrame, as_of: str, schema_version: str | None = None) -> DataFrame:
    """Label, required properties, id form, confidence range, timestamps (DQ10, DQ12).

    ``entities`` has ``uuid, label, confidence, created_at (text), schema_version, props (map)``.
    """
    needs = F.create_map(*[x for k, v in REQUIRED_PROPERTIES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    missing = F.array_except(needs[F.col("label")], F.map_keys("props"))
    at = F.try_to_timestamp(F.col("created_at"))
    rules = [
        ("label", "error", ~F.col("label").isin(*NODE_LABELS), F.concat(F.lit("Unknown label: "), F.col("label"))),
        ("required", "error", F.size(missing) > 0, F.concat(F.lit("Missing: "), F.array_join(missing, ","))),
        ("uuid", "error", ~F.col("uuid").rlike(UUID), "Invalid UUID"),
        ("confidence", "error", ~F.col("confidence").between(0.0, 1.0), "Confidence outside [0, 1]"),
        ("timestamp", "error", at.isNull(), "Invalid timestamp"),
        ("timestamp", "error", at > F.lit(as_of).cast("timestamp"), "Timestamp in the future"),
    ]
    if schema_version is not None:
        rules.append(("schema_version", "warning", F.col("schema_version") != schema_version, "Schema version differs"))
    return row_issues(entities, "entity", rules, "uuid")


def edge_issues(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Known type, no temporal self-loop, optionally allowed end labels (DQ11).

    ``edges`` has ``edge_id, rel_type, src, dst, src_label, dst_label``.
    """
    rules = [
        ("rel_type", "error", ~F.col("rel_type").isin(*ALLOWED_EDGES, *OTHER_EDGE_TYPES), F.concat(F.lit("Unknown type: "), F.col("rel_type"))),
        ("self_loop", "error", F.col("rel_type").isin(*TEMPORAL_EDGES) & (F.col("src") == F.col("dst")), "Temporal self-loop"),
    ]
    if strict:
        ends = F.create_map(*[F.lit(x) for k, v in ALLOWED_EDGES.items() for x in (k, f"{v[0]}>{v[1]}")])
        rules.append(("ends", "error", ends[F.col("rel_type")] != F.concat_ws(">", "src_label", "dst_label"), "End labels not allowed"))
    return row_issues(edges, "edge", rules, "edge_id")


def graph_issues(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Repeated nodes, dangling edges, sessions without temporal edges, empty graph (DQ13)."""
    repeated = duplicates(node, ["node_id"])
    ids = node.select("node_id").distinct()
    ends = edge.select(F.col("src").alias("node_id")).unionAll(edge.select(F.col("dst").alias("node_id"))).distinct()
    loose = ends.join(ids, "node_id", "left_anti")
    sizes = node.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "Session").alias("sessions")).crossJoin(
        edge.agg(F.count_if(F.col("rel_type").isin(*TEMPORAL_EDGES)).alias("temporal"))
    )
    return union([
        issue(repeated, "graph", "duplicate", "error", F.concat(F.lit("Duplicate node: "), F.col("node_id")), None),
        issue(loose, "graph", "dangling", "error", F.concat(F.lit("Edge end without node: "), F.col("node_id")), None),
        issue(sizes.filter("sessions > 1 AND temporal = 0"), "graph", "temporal", "warning", "No temporal edges", None),
        issue(sizes.filter("nodes = 0"), "graph", "empty", "error", "Empty graph", None),
    ])


# --- media metadata -----------------------------------------------------------------------------
def corruption(participants: DataFrame) -> DataFrame:
    """Zero-length audio, empty transcript, excluded label, empty file (DQ14, DQ24)."""
    return row_issues(participants, "corruption", [
        ("corruption", "error", F.col("audio_length") <= 0, "Broken audio: zero duration"),
        ("corruption", "error", (F.col("transcript_length") == 0) & F.col("has_transcript"), "Empty transcript"),
        ("corruption", "warning", F.col("label") == "excluded", "Invalid/excluded label"),
        ("corruption", "error", F.col("file_size") == 0, "Empty file"),
    ])


def frame_rate_issues(videos: DataFrame, min_size: int = 64) -> DataFrame:
    """Frame rate near a usual one, smallest picture size (DQ18)."""
    off = F.array_min(F.array(*[F.abs(F.col("fps") - float(r)) for r in FRAME_RATES]))
    return row_issues(videos, "video", [
        ("fps", "error", F.col("fps") <= 0, "invalid_fps"),
        ("fps", "warning", (F.col("fps") > 0) & (off > 5), "fps_warning"),
        ("resolution", "error", (F.col("width") < min_size) | (F.col("height") < min_size), "resolution_too_small"),
    ])


def result_issues(results: DataFrame) -> DataFrame:
    """Empty text, NaN, wrong dimension, negative language confidence (DQ23).

    ``results`` has ``participant_id, text, v, dim, language_confidence``.
    """
    return row_issues(results, "result", [
        ("text", "error", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "empty_text"),
        ("embedding", "error", F.exists("v", lambda x: F.isnan(x)), "nan_embedding"),
        ("embedding", "error", F.size("v") != F.col("dim"), "embedding_dim_mismatch"),
        ("language", "error", F.col("language_confidence") < 0, "invalid_language_confidence"),
    ])
