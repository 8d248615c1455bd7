"""Validation gates over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import gates as gt
from tidewell.plans.dataset import CAT_SQL, MOVED, SES, idx, moved
from tidewell.plans.registry import add, q4

Q = ("SELECT participant_id, session_id, CASE WHEN has_audio THEN q ELSE 0e0 END AS a, CASE WHEN has_visual THEN q ELSE 0e0 END AS v, CASE WHEN has_transcript THEN q ELSE 0e0 END AS x, y FROM "
     "(SELECT *, CASE WHEN coalesce(quality_score, 0) = 0 THEN 8e-1 ELSE quality_score END AS q, CASE WHEN coalesce(sync_score, 0) = 0 THEN 1e0 ELSE sync_score END AS y FROM " + SES + ")")
Q = f"SELECT participant_id, session_id, {q4('a')} AS audio, {q4('v')} AS video, {q4('x')} AS transcript, {q4('y')} AS sync, {q4('25e-2 * a + 2e-1 * v + 25e-2 * x + 15e-2 * y + 15e-2 * 9e-1')} AS overall FROM ({Q})"
add("MTH12_participant_quality", lambda t: gt.quality_scores(idx(t)), f"SELECT *, {CAT_SQL.format('overall')} AS category FROM ({Q})", "dataset_index")
add("DQ3_quality_gate", lambda t: gt.quality_verdict(idx(t)),
    f"SELECT count(CASE WHEN overall < 3e-1 THEN 1 END) AS rejected, count(*) AS total, CASE WHEN count(CASE WHEN overall < 3e-1 THEN 1 END) < count(*) * 5e-1 THEN 'passed' ELSE 'warning' END AS status FROM ({Q})", "dataset_index")
add("DQ22_low_quality", lambda t: gt.quality_scores(idx(t)).filter("overall < 0.5").select("participant_id", "overall"), f"SELECT participant_id, overall FROM ({Q}) WHERE overall < 5e-1", "dataset_index")


def messy(t):
    """The session index with some odd splits, labels and repeats."""
    m = moved(t)
    return m.selectExpr("participant_id", "participant_id AS session_id", "'d' AS dataset", "IF(split = 'dev', 'holdout', split) AS split", "IF(label = 'normal', 'odd', label) AS label")


MESSY = f"(SELECT participant_id, CASE WHEN split = 'dev' THEN 'holdout' ELSE split END AS split, CASE WHEN label = 'normal' THEN 'odd' ELSE label END AS label FROM {MOVED})"
CONS = (f"SELECT 'consistency' AS gate, 'duplicate_session' AS check, 'error' AS severity, 'Conflicting session records' AS message, participant_id FROM (SELECT participant_id FROM {MESSY} GROUP BY 1 HAVING count(*) > 1) "
        f"UNION ALL SELECT 'consistency', 'split', 'warning', 'Non-standard split', participant_id FROM {MESSY} WHERE split = 'holdout' "
        f"UNION ALL SELECT 'consistency', 'label', 'warning', 'Non-standard label', participant_id FROM {MESSY} WHERE label = 'odd'")
add("DQ2_consistency_gate", lambda t: gt.consistency(messy(t)), CONS)


def leak(t):
    return gt.leakage(messy(t), t.pages.selectExpr("regexp_replace(url, '[?].*$', '') AS file_path"))


LEAK = (f"SELECT 'leakage' AS gate, 'split_leakage' AS check, 'error' AS severity, 'Participant in multiple splits: ' || count(DISTINCT split) AS message, participant_id FROM {MESSY} GROUP BY participant_id HAVING count(DISTINCT split) > 1 "
        "UNION ALL SELECT 'leakage', 'duplicate_file', 'error', 'Duplicated file: ' || list_extract(string_split(file_path, '/'), -1), NULL FROM (SELECT regexp_replace(url, '[?].*$', '') AS file_path FROM pages) GROUP BY file_path HAVING count(*) > 1 "
        f"UNION ALL SELECT 'leakage', 'duplicate_session', 'error', 'Duplicated session', participant_id FROM {MESSY} GROUP BY participant_id HAVING count(*) > 1")
add("DQ7_leakage_gate", leak, LEAK)
ALLOWED = {"transcript": (".txt", ".csv"), "audio": (".wav",)}


def files(t):
    base = t.dataset_index.selectExpr("participant_id", "modality", "IF(transcript_length % 11 = 0, '', concat('/data/', participant_id, '/', modality, IF(modality = 'audio', '.wav', IF(transcript_length % 3 = 0, '.pdf', '.txt')))) AS file_path")
    listing = base.filter("file_path <> ''").selectExpr("file_path", "participant_id").distinct().filter("CAST(participant_id AS BIGINT) % 6 <> 5").selectExpr("file_path", "CAST(participant_id AS BIGINT) % 4 AS size")
    return base, listing


FBASE = "(SELECT participant_id, modality, CASE WHEN transcript_length % 11 = 0 THEN '' ELSE '/data/' || participant_id || '/' || modality || CASE WHEN modality = 'audio' THEN '.wav' WHEN transcript_length % 3 = 0 THEN '.pdf' ELSE '.txt' END END AS file_path FROM dataset_index)"
FJOIN = f"(SELECT b.*, l.size FROM {FBASE} b LEFT JOIN (SELECT DISTINCT file_path, CAST(participant_id AS BIGINT) % 4 AS size FROM {FBASE} WHERE file_path <> '' AND CAST(participant_id AS BIGINT) % 6 <> 5) l ON l.file_path = b.file_path)"
NAME = "list_extract(string_split(file_path, '/'), -1)"
INTEG = (f"SELECT 'integrity' AS gate, 'existence' AS check, 'error' AS severity, 'Missing file path' AS message, participant_id FROM {FJOIN} WHERE file_path = '' "
         f"UNION ALL SELECT 'integrity', 'existence', 'error', 'File missing: ' || {NAME}, participant_id FROM {FJOIN} WHERE file_path <> '' AND size IS NULL "
         f"UNION ALL SELECT 'integrity', 'size', 'error', 'Too small (' || size || ' bytes)', participant_id FROM {FJOIN} WHERE size < 1 "
         f"UNION ALL SELECT 'integrity', 'extension', 'warning', 'Unexpected extension .pdf', participant_id FROM {FJOIN} WHERE size IS NOT NULL AND modality = 'transcript' AND file_path LIKE '%.pdf' "
         f"UNION ALL SELECT 'integrity', 'duplicate', 'warning', 'Duplicate path: ' || {NAME}, participant_id FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY participant_id) AS r FROM {FJOIN} WHERE size IS NOT NULL) WHERE r > 1")
add("DQ1_integrity_gate", lambda t: gt.integrity(*files(t), ALLOWED), INTEG, "dataset_index")


def vec(t):
    """Vectors with a few spoiled by NaN, infinity and truncation."""
    return t.embeddings.selectExpr("CAST(vec_id AS STRING) AS participant_id", "IF(label % 2 = 0, 'audio', 'text') AS modality",
                                   "CASE WHEN vec_id % 25 = 3 THEN concat(array(CAST('NaN' AS FLOAT)), embedding) WHEN vec_id % 25 = 4 THEN concat(array(CAST('Infinity' AS FLOAT)), embedding) "
                                   "WHEN vec_id % 25 = 5 THEN slice(embedding, 1, 0) ELSE embedding END AS v", "IF(vec_id % 20 = 0, NULL, 'v1') AS model_version")


VEC = "SELECT 'features' AS gate, '{0}' AS check, 'error' AS severity, '{1} in ' || CASE WHEN label % 2 = 0 THEN 'audio' ELSE 'text' END AS message, CAST(vec_id AS VARCHAR) AS participant_id FROM embeddings WHERE vec_id % 25 = {2}"
VECS = VEC.format("nan", "NaN", 3) + " UNION ALL " + VEC.format("inf", "Inf", 4)
add("DQ4_feature_gate", lambda t: gt.vectors(vec(t)), VECS)
EMB = ("SELECT 'embeddings' AS gate, 'empty_embedding' AS check, 'error' AS severity, 'Empty embedding' AS message, CAST(vec_id AS VARCHAR) AS participant_id FROM embeddings WHERE vec_id % 25 = 5 "
       "UNION ALL SELECT 'embeddings', 'metadata', 'warning', 'Missing version in sidecar', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 20 = 0 "
       "UNION ALL SELECT 'embeddings', 'duplicate_embedding', 'error', 'Duplicate embedding checksum', p FROM (SELECT p, row_number() OVER (PARTITION BY e ORDER BY p) AS r FROM "
       "(SELECT CAST(vec_id AS VARCHAR) AS p, CASE WHEN vec_id % 25 = 5 THEN 'empty' ELSE CAST(embedding AS VARCHAR) || (CASE WHEN vec_id % 25 IN (3, 4) THEN vec_id % 25 ELSE 0 END) END AS e FROM embeddings)) WHERE r > 1")
add("DQ5_embedding_gate", lambda t: gt.embeddings(vec(t)), EMB)
add("DQ6_statistics_gate", lambda t: idx(t).agg(F.count("*").alias("n")).select(F.lit("statistics").alias("gate"), F.when(F.col("n") == 0, "warning").otherwise("passed").alias("status")),
    "SELECT 'statistics' AS gate, CASE WHEN count(*) = 0 THEN 'warning' ELSE 'passed' END AS status FROM dataset_index", "dataset_index")


def every_issue(t):
    return gt.union([gt.integrity(*files(t), ALLOWED), gt.consistency(messy(t)), gt.quality(idx(t)), leak(t), gt.vectors(vec(t)), gt.embeddings(vec(t))])


QISS = f"SELECT 'quality' AS gate, 'quality_reject' AS check, 'warning' AS severity, 'Quality below threshold' AS message, participant_id FROM ({Q}) WHERE overall < 3e-1"
ROLL = (f"SELECT g AS gate, count(gate) AS issues, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, CASE WHEN count(CASE WHEN severity = 'error' THEN 1 END) = 0 THEN 'passed' WHEN g IN ('features', 'embeddings') THEN 'warning' ELSE 'failed' END AS status "
        f"FROM (VALUES ('integrity'), ('consistency'), ('quality'), ('leakage'), ('features'), ('embeddings')) v(g) LEFT JOIN (({INTEG}) UNION ALL ({CONS}) UNION ALL ({QISS}) UNION ALL ({LEAK}) UNION ALL ({VECS}) UNION ALL ({EMB})) i ON i.gate = g GROUP BY g")
ISSUES = f"({INTEG}) UNION ALL ({CONS}) UNION ALL ({QISS}) UNION ALL ({LEAK}) UNION ALL ({VECS}) UNION ALL ({EMB})"
GATES = ("integrity", "consistency", "quality", "leakage", "features", "embeddings")
add("DQ9_gate_roll_up", lambda t: gt.roll_up(every_issue(t), gates=GATES), ROLL, "dataset_index")
add("DQ9_approval", lambda t: gt.approval(gt.roll_up(every_issue(t), gates=GATES)),
    f"SELECT count(*) AS gates, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'failed' THEN 1 END) = 0 AS approved FROM ({ROLL})", "dataset_index")
add("SNK12_report_counts", lambda t: every_issue(t).groupBy("gate", "severity").agg(F.count("*").alias("n")),
    f"SELECT gate, severity, count(*) AS n FROM (({INTEG}) UNION ALL ({CONS}) UNION ALL ({QISS}) UNION ALL ({LEAK}) UNION ALL ({VECS}) UNION ALL ({EMB})) GROUP BY 1, 2", "dataset_index")


def entities(t):
    c = t.checkin
    uuid = F.when(F.col("k") % 11 == 0, "bad-id").otherwise(F.concat_ws("-", F.lit("00000000"), F.lit("0000"), F.lit("4000"), F.lit("8000"), F.lpad(F.col("id").cast("string"), 12, "0")))
    keys = F.array(F.lit("emotion_id"), F.lit("emotion_name"), F.lit("probability"), F.lit("confidence"), F.when(F.col("k") % 7 == 0, "extra").otherwise("timestamp"))
    return c.select(uuid.alias("uuid"), F.when(F.col("k") % 13 == 0, "Ghost").otherwise("Emotion").alias("label"), (F.col("k") / 90.0).alias("confidence"),
                    F.when(F.col("k") % 17 == 0, "never").when(F.col("k") % 19 == 0, "2031-01-01 00:00:00").otherwise("2024-01-01 00:00:00").alias("created_at"),
                    F.when(F.col("k") % 23 == 0, "1.0").otherwise("2.0").alias("schema_version"), F.map_from_arrays(keys, F.transform(keys, lambda x: F.lit("x"))).alias("props"))


EU = "CASE WHEN k % 11 = 0 THEN 'bad-id' ELSE '00000000-0000-4000-8000-' || lpad(CAST(id AS VARCHAR), 12, '0') END"
ENT = " UNION ALL ".join(f"SELECT 'entity' AS gate, '{check}' AS check, '{sev}' AS severity, '{msg}' AS message, {EU} AS participant_id FROM checkin WHERE {cond}" for check, sev, msg, cond in (
    ("label", "error", "Unknown label: Ghost", "k % 13 = 0"), ("required", "error", "Missing: timestamp", "k % 7 = 0 AND k % 13 <> 0"), ("uuid", "error", "Invalid UUID", "k % 11 = 0"),
    ("confidence", "error", "Confidence outside [0, 1]", "k / 9e1 > 1"), ("timestamp", "error", "Invalid timestamp", "k % 17 = 0"),
    ("timestamp", "error", "Timestamp in the future", "k % 19 = 0 AND k % 17 <> 0")))
add("DQ10_entity_validation", lambda t: gt.entity_issues(entities(t), "2025-01-01 00:00:00"), ENT, "checkin")
add("DQ12_schema_version", lambda t: gt.entity_issues(entities(t), "2025-01-01 00:00:00", "2.0").filter("check = 'schema_version'"),
    f"SELECT 'entity' AS gate, 'schema_version' AS check, 'warning' AS severity, 'Schema version differs' AS message, {EU} AS participant_id FROM checkin WHERE k % 23 = 0", "checkin")


def edges(t):
    return t.checkin.selectExpr("id AS edge_id", "CASE WHEN k % 8 = 0 THEN 'LIKES' WHEN k % 8 < 4 THEN 'TEMPORALLY_PRECEDES' ELSE 'INDICATES' END AS rel_type", "k AS src", "CAST(value AS INT) AS dst",
                                "'Session' AS src_label", "IF(k % 2 = 0, 'Session', 'Symptom') AS dst_label")


EDG = (f"SELECT 'edge' AS gate, 'rel_type' AS check, 'error' AS severity, 'Unknown type: LIKES' AS message, CAST(id AS VARCHAR) AS participant_id FROM checkin WHERE k % 8 = 0 "
       "UNION ALL SELECT 'edge', 'self_loop', 'error', 'Temporal self-loop', CAST(id AS VARCHAR) FROM checkin WHERE k % 8 BETWEEN 1 AND 3 AND k = CAST(trunc(value) AS INT) "
       "UNION ALL SELECT 'edge', 'ends', 'error', 'End labels not allowed', CAST(id AS VARCHAR) FROM checkin WHERE (k % 8 BETWEEN 1 AND 3 AND k % 2 = 1) OR k % 8 >= 4")
add("DQ11_edge_validation", lambda t: gt.edge_issues(edges(t), strict=True), EDG, "checkin")
DANG = "SELECT node_id FROM (SELECT src AS node_id FROM edge UNION SELECT dst FROM edge) WHERE node_id NOT IN (SELECT node_id FROM node WHERE label <> 'Symptom')"
add("DQ13_graph_validation", lambda t: gt.graph_issues(t.node.filter("label <> 'Symptom'"), t.edge),
    "SELECT 'graph' AS gate, 'duplicate' AS check, 'error' AS severity, 'Duplicate node: ' || node_id AS message, CAST(NULL AS VARCHAR) AS participant_id FROM node WHERE label <> 'Symptom' GROUP BY node_id HAVING count(*) > 1 "
    f"UNION ALL SELECT 'graph', 'dangling', 'error', 'Edge end without node: ' || node_id, NULL FROM ({DANG})", "node edge")


def people(t):
    return idx(t).selectExpr("participant_id", "IF(transcript_length % 4 = 0, 0e0, audio_length) AS audio_length", "IF(transcript_length % 5 = 0, 0, transcript_length) AS transcript_length", "has_transcript",
                             "IF(label = 'unknown', 'excluded', label) AS label", "transcript_length % 3 AS file_size")


add("DQ14_corruption", lambda t: gt.corruption(people(t)),
    " UNION ALL ".join(f"SELECT 'corruption' AS gate, 'corruption' AS check, '{sev}' AS severity, '{msg}' AS message, participant_id FROM {SES} WHERE {cond}" for sev, msg, cond in (
        ("error", "Broken audio: zero duration", "transcript_length % 4 = 0 OR audio_length <= 0"), ("error", "Empty transcript", "transcript_length % 5 = 0 AND has_transcript"),
        ("warning", "Invalid/excluded label", "label = 'unknown'"), ("error", "Empty file", "transcript_length % 3 = 0"))), "dataset_index")
add("DQ24_corruption_report", lambda t: gt.corruption(people(t)).groupBy("severity", "message").agg(F.count("*").alias("n")),
    " UNION ALL ".join(f"SELECT '{sev}' AS severity, '{msg}' AS message, count(*) AS n FROM {SES} WHERE {cond} HAVING count(*) > 0" for sev, msg, cond in (
        ("error", "Broken audio: zero duration", "transcript_length % 4 = 0 OR audio_length <= 0"), ("error", "Empty transcript", "transcript_length % 5 = 0 AND has_transcript"),
        ("warning", "Invalid/excluded label", "label = 'unknown'"), ("error", "Empty file", "transcript_length % 3 = 0"))), "dataset_index")
add("DQ15_listing_rules", lambda t: gt.row_issues(t.pages.selectExpr("url AS participant_id", "length(html) AS size"), "listing", [
        ("extension", "warning", ~F.col("participant_id").rlike("[.](html|htm)([?#]|$)"), "Unexpected extension"), ("empty", "error", F.col("size") == 0, "Empty file")]),
    "SELECT 'listing' AS gate, 'extension' AS check, 'warning' AS severity, 'Unexpected extension' AS message, url AS participant_id FROM pages WHERE NOT regexp_matches(url, '[.](html|htm)([?#]|$)') "
    "UNION ALL SELECT 'listing', 'empty', 'error', 'Empty file', url FROM pages WHERE length(html) = 0")
add("DQ18_video_checks", lambda t: gt.frame_rate_issues(t.checkin.selectExpr("id AS participant_id", "value AS fps", "k AS width", "k + 10 AS height")),
    "SELECT 'video' AS gate, 'fps' AS check, 'error' AS severity, 'invalid_fps' AS message, CAST(id AS VARCHAR) AS participant_id FROM checkin WHERE value <= 0 "
    "UNION ALL SELECT 'video', 'fps', 'warning', 'fps_warning', CAST(id AS VARCHAR) FROM checkin WHERE value > 0 AND list_min(list_transform([1, 2, 5, 10, 15, 24, 25, 30], lambda r: abs(value - r))) > 5 "
    "UNION ALL SELECT 'video', 'resolution', 'error', 'resolution_too_small', CAST(id AS VARCHAR) FROM checkin WHERE k < 64", "checkin")
add("DQ19_feature_report", lambda t: vec(t).agg(F.count("*").alias("total"), F.count_if(~F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("passed")),
    "SELECT count(*) AS total, count(CASE WHEN vec_id % 25 NOT IN (3, 4) THEN 1 END) AS passed FROM embeddings")
add("DQ20_file_rules", lambda t: gt.row_issues(t.documents.selectExpr("CAST(doc_id AS STRING) AS participant_id", "trim(text) AS text", "n_chars"), "file", [
        ("transcript_validation", "warning", F.col("text") == "", "empty_transcript"), ("length", "warning", F.col("n_chars") < 200, "short_file")]),
    "SELECT 'file' AS gate, 'transcript_validation' AS check, 'warning' AS severity, 'empty_transcript' AS message, CAST(doc_id AS VARCHAR) AS participant_id FROM documents WHERE trim(text) = '' "
    "UNION ALL SELECT 'file', 'length', 'warning', 'short_file', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars < 200")
add("DQ21_expected_samples", lambda t: t.dataset_index.agg(F.count("*").alias("samples"), F.count_distinct("participant_id").alias("participants")).withColumn("as_expected", F.col("samples") == 2 * F.col("participants")),
    "SELECT count(*) AS samples, count(DISTINCT participant_id) AS participants, count(*) = 2 * count(DISTINCT participant_id) AS as_expected FROM dataset_index", "dataset_index")
add("DQ23_result_validation", lambda t: gt.result_issues(vec(t).selectExpr("participant_id", "IF(model_version IS NULL, ' ', 'text') AS text", "v", "64 AS dim", "IF(CAST(participant_id AS INT) % 30 = 1, -1e0, 5e-1) AS language_confidence")),
    " UNION ALL ".join(f"SELECT 'result' AS gate, '{check}' AS check, 'error' AS severity, '{msg}' AS message, CAST(vec_id AS VARCHAR) AS participant_id FROM embeddings WHERE {cond}" for check, msg, cond in (
        ("text", "empty_text", "vec_id % 20 = 0"), ("embedding", "nan_embedding", "vec_id % 25 = 3"), ("embedding", "embedding_dim_mismatch", "vec_id % 25 IN (3, 4, 5)"), ("language", "invalid_language_confidence", "vec_id % 30 = 1"))))
