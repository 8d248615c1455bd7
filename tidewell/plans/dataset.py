"""Dataset index, statistics, duplicates, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import quality as ql
from tidewell.functions.multiset import multiset_state, state_hash, updated
from tidewell.functions.numeric import r4, r9
from tidewell.operators import dataset as ds
from tidewell.operators.ordered import exact_quantiles
from tidewell.plans.registry import add, q4, q9
from tidewell.schemas import LABEL_TEXTS

INDEX_SQL = (
    "SELECT participant_id, session_id, dataset, coalesce(arg_min(split, file_path) FILTER (WHERE true), 'unknown') AS split, arg_min(label, file_path) AS label, arg_min(language, file_path) AS language, "
    "bool_or(modality = 'audio') AS has_audio, bool_or(modality LIKE '%transcript%') AS has_transcript, bool_or(modality IN ('video', 'visual', 'facial_features')) AS has_visual, "
    "coalesce(min(CASE WHEN modality = 'audio' THEN file_path END), '') AS audio_path, coalesce(min(CASE WHEN modality LIKE '%transcript%' THEN file_path END), '') AS transcript_path, "
    "coalesce(min(CASE WHEN regexp_matches(modality, 'video|visual|facial') THEN file_path END), '') AS video_path, arg_min(audio_length, file_path) AS audio_length, "
    "CAST(arg_min(transcript_length, file_path) AS BIGINT) AS transcript_length, "
    "CASE WHEN arg_min(quality_score, file_path) = 0 THEN 8e-1 ELSE arg_min(quality_score, file_path) END AS quality_score, "
    "CASE WHEN arg_min(sync_score, file_path) = 0 THEN 1e0 ELSE arg_min(sync_score, file_path) END AS sync_score FROM dataset_index GROUP BY 1, 2, 3")
SES = f"({INDEX_SQL}) s"


def idx(t):
    return ds.session_index(t.dataset_index)


def rounded_all(df):
    return df.select(*[r9(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


add("AGG1_session_index", lambda t: idx(t), INDEX_SQL, "dataset_index")
add("AGG7_grouped_counts", lambda t: ds.grouped_counts(t.dataset_index),
    " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, '{'unassigned' if c == 'split' else 'unknown'}') AS value, count(*) AS n FROM dataset_index GROUP BY 1, 2"
                       for c in ("dataset", "modality", "label", "language", "split")), "dataset_index")
add("AGG8_participant_statistics", lambda t: rounded_all(ds.participant_statistics(idx(t))),
    f"SELECT count(*) AS participant_count, count(DISTINCT session_id) AS session_count, {q9('avg(nullif(audio_length, 0))')} AS average_duration, {q9('median(nullif(audio_length, 0))')} AS median_duration, "
    f"{q9('sum(audio_length) / 36e2')} AS total_hours, {q9('avg(nullif(transcript_length, 0))')} AS avg_transcript_length FROM {SES}", "dataset_index")
add("AGG9_session_statistics", lambda t: rounded_all(ds.session_statistics(idx(t))),
    f"SELECT count(DISTINCT participant_id) AS participants, count(*) AS sessions, {q9('avg(audio_length)')} AS avg_audio_length, {q9('avg(transcript_length)')} AS avg_transcript_length, "
    "count(CASE WHEN NOT has_audio THEN 1 END) AS missing_audio, count(CASE WHEN NOT has_visual THEN 1 END) AS missing_visual, count(CASE WHEN NOT has_transcript THEN 1 END) AS missing_text, "
    + ", ".join(f"{q9(e)} AS quality_{n}" for n, e in {"mean": "avg(quality_score)", "std": "stddev_samp(quality_score)", "min": "min(quality_score)", "q25": "quantile_cont(quality_score, 25e-2)",
                                                     "q50": "quantile_cont(quality_score, 5e-1)", "q75": "quantile_cont(quality_score, 75e-2)", "max": "max(quality_score)"}.items()) + f" FROM {SES}", "dataset_index")
NUM = ("audio_length", "transcript_length", "quality_score", "sync_score")
add("AGG10_numeric_profile", lambda t: rounded_all(ds.numeric_profile(idx(t), NUM)),
    " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, {q9(f'avg({c})')} AS mean, {q9(f'median({c})')} AS median, {q9(f'var_samp({c})')} AS variance, {q9(f'stddev_samp({c})')} AS std, "
                       f"{q9(f'coalesce(skewness({c}), 0e0)')} AS skewness, {q9(f'coalesce(kurtosis({c}), 0e0)')} AS kurtosis, {q9(f'quantile_cont({c}, 25e-2)')} AS q25, {q9(f'quantile_cont({c}, 75e-2)')} AS q75 FROM {SES}" for c in NUM), "dataset_index")
add("AGG11_class_distribution", lambda t: rounded_all(ds.class_distribution(t.scored)),
    f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS classes, {q9('min(n) / max(n)')} AS imbalance_ratio, {q9('min(n) / sum(n)')} AS minority_pct, {q9('max(n) / sum(n)')} AS majority_pct, "
    "CASE WHEN min(n) / sum(n) < 15e-2 THEN 'weighted_sampler' ELSE 'random' END AS recommended_sampling FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY 1)", "scored")
add("AGG12_class_weights", lambda t: rounded_all(ds.class_weights(t.scored)),
    f"SELECT label, n, {q9('sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE))')} AS weight FROM (SELECT label, count(*) AS n FROM scored WHERE label >= 0 GROUP BY 1)", "scored")
add("AGG12_sample_weights", lambda t: ds.sample_weights(t.scored).select("doc_id", r9("sample_weight").alias("sample_weight")),
    f"SELECT doc_id, {q9('CASE WHEN label >= 0 THEN 1e0 / count(*) OVER (PARTITION BY label) ELSE 0e0 END')} AS sample_weight FROM scored", "scored")
add("AGG13_extents", lambda t: rounded_all(ds.extents(idx(t), "audio_length")),
    f"SELECT {q9('avg(audio_length)')} AS avg_duration, {q9('max(audio_length)')} AS max_duration, {q9('min(audio_length)')} AS min_duration FROM {SES}", "dataset_index")
add("AGG15_corpus_statistics", lambda t: rounded_all(idx(t).agg(F.count("*").alias("n"), F.avg("audio_length").alias("avg_duration"),
                                                               F.avg("sync_score").alias("avg_speech_ratio"), (1 - F.avg("sync_score")).alias("avg_silence_ratio"),
                                                               (F.count_if(F.col("quality_score") >= 0.5) / F.count("*")).alias("pass_rate")).crossJoin(
                                                               exact_quantiles(idx(t), "audio_length", [0.5]).withColumnRenamed("q0", "median_duration"))),
    f"SELECT count(*) AS n, {q9('avg(audio_length)')} AS avg_duration, {q9('median(audio_length)')} AS median_duration, {q9('avg(sync_score)')} AS avg_speech_ratio, {q9('1 - avg(sync_score)')} AS avg_silence_ratio, "
    f"{q9('count(CASE WHEN quality_score >= 5e-1 THEN 1 END) / CAST(count(*) AS DOUBLE)')} AS pass_rate FROM {SES}", "dataset_index")


def counts_text(column):
    return f"(SELECT string_agg(coalesce({column}, 'unknown') || '=' || n, ',' ORDER BY coalesce({column}, 'unknown') || '=' || n) FROM (SELECT {column}, count(*) AS n FROM dataset_index GROUP BY 1))"


def hash_sql(source, columns, doubles=()):
    """Twin of the multiset hash: length before each field, four 52-bit lanes, their sums hashed."""
    def field(c):
        text = f"CAST(CAST(floor({c} * 1e9 + 5e-1) AS BIGINT) AS VARCHAR)" if c in doubles else f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE length({text}) || ':' || {text} END"

    lanes = " || ':' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(d, {1 + 13 * k}, 13) AS BIGINT)), 0) AS VARCHAR)" for k in range(4))
    return f"(SELECT sha256(CAST(count(*) AS VARCHAR) || ':' || {lanes}) FROM (SELECT sha256({' || '.join(field(c) for c in columns)}) AS d FROM {source}))"


add("AGG22_manifest", lambda t: ds.manifest(t.dataset_index),
    f"SELECT (SELECT count(*) FROM dataset_index) AS sample_count, {counts_text('label')} AS labels, {counts_text('language')} AS languages, {hash_sql('dataset_index', ('participant_id', 'file_path'))} AS content_hash", "dataset_index")


def after_changes(t):
    """Hash of the index once its text rows are gone and its audio rows stand twice, from the states of those rows alone."""
    def state(rows):
        return multiset_state(rows, ("participant_id", "file_path"))

    index = t.dataset_index
    return updated(state(index), state(index.filter("modality = 'audio'")), state(index.filter("modality LIKE '%transcript%'"))).select("rows", state_hash().alias("content_hash"))


CHANGED = "(SELECT * FROM dataset_index WHERE modality NOT LIKE '%transcript%' UNION ALL SELECT * FROM dataset_index WHERE modality = 'audio')"
add("AGG22_changed_hash", after_changes, f"SELECT (SELECT count(*) FROM {CHANGED}) AS rows, {hash_sql(CHANGED, ('participant_id', 'file_path'))} AS content_hash", "dataset_index")
SESSION_COLUMNS = ("participant_id", "session_id", "dataset", "split", "label", "language", "has_audio", "has_transcript", "has_visual", "audio_path", "transcript_path", "video_path", "audio_length",
                   "transcript_length", "quality_score", "sync_score")
add("AGG23_passport", lambda t: ds.passport(idx(t).select(*SESSION_COLUMNS)),
    f"SELECT count(*) AS num_samples, count(DISTINCT participant_id) AS participants, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, {q4('avg(quality_score)')} AS quality_score, "
    f"'approved' AS validation_status, {hash_sql(SES, SESSION_COLUMNS, ('audio_length', 'quality_score', 'sync_score'))} AS content_hash FROM {SES}", "dataset_index")

# --- projections on the dataset side ---------------------------------------------------------------
add("PRJ7_split_filter", lambda t: t.dataset_index.filter("split = 'train' AND dataset = 'dvlog'").select("participant_id", "file_path"),
    "SELECT participant_id, file_path FROM dataset_index WHERE split = 'train' AND dataset = 'dvlog'", "dataset_index")
RAW_LABEL = "CASE k % 9 WHEN 0 THEN ' Depressed ' WHEN 1 THEN 'no' WHEN 2 THEN 'drop' WHEN 3 THEN '1' WHEN 4 THEN 'FALSE' WHEN 5 THEN '' WHEN 6 THEN 'high' WHEN 7 THEN 'normal' ELSE 'other' END"
CLASS_SQL = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'" for k, vs in LABEL_TEXTS.items()) + " ELSE 'unknown' END"
LAB = f"(SELECT id, raw, lower(trim(raw)) AS x FROM (SELECT id, {RAW_LABEL} AS raw FROM checkin))"


def raw_labels(t):
    return t.checkin.select("id", F.expr(RAW_LABEL).alias("raw"))


add("PRJ8_label_class", lambda t: raw_labels(t).select("id", ql.label_class(F.col("raw")).alias("label")), f"SELECT id, {CLASS_SQL} AS label FROM {LAB}", "checkin")
add("PRJ9_label_int", lambda t: raw_labels(t).select("id", ql.label_int(ql.label_class(F.col("raw"))).alias("label"), ql.label_int(ql.label_class(F.col("raw")), {"depression": 1, "normal": 0}).alias("binary")),
    f"SELECT id, CASE c WHEN 'depression' THEN 1 WHEN 'normal' THEN 0 WHEN 'excluded' THEN -2 ELSE -1 END AS label, CASE c WHEN 'depression' THEN 1 WHEN 'normal' THEN 0 ELSE -1 END AS binary FROM (SELECT id, {CLASS_SQL} AS c FROM {LAB})", "checkin")
CAT_SQL = "CASE WHEN {0} >= 85e-2 THEN 'excellent' WHEN {0} >= 7e-1 THEN 'good' WHEN {0} >= 5e-1 THEN 'acceptable' WHEN {0} >= 3e-1 THEN 'poor' ELSE 'rejected' END"
add("PRJ10_quality_band", lambda t: t.session.select("session_id", ql.category(F.col("quality_score")).alias("category")),
    f"SELECT session_id, {CAT_SQL.format('quality_score')} AS category FROM session", "session")
add("PRJ13_binary_label", lambda t: raw_labels(t).select("id", ql.positive_label(F.trim("raw")).alias("binary")),
    f"SELECT id, CASE WHEN x IN ('high', '1', 'depressed', 'positive') THEN 1 ELSE 0 END AS binary FROM {LAB}", "checkin")
add("PRJ14_zero_default", lambda t: t.dataset_index.select("file_path", ql.blank_or_zero("quality_score", 0.8).alias("quality_score")),
    "SELECT file_path, CASE WHEN quality_score IS NULL OR quality_score = 0 THEN 8e-1 ELSE quality_score END AS quality_score FROM dataset_index", "dataset_index")
add("MAP1_modality_mask", lambda t: idx(t).select("participant_id", F.create_map(F.lit("audio"), F.col("has_audio"), F.lit("visual"), F.col("has_visual"), F.lit("text"), F.col("has_transcript"),
                                                                                F.lit("image"), F.lit(False), F.lit("graph"), F.lit(False)).alias("m")).select(
        "participant_id", F.explode("m").alias("modality", "present")),
    "SELECT participant_id, modality, present FROM (" + " UNION ALL ".join(f"SELECT participant_id, '{m}' AS modality, {c} AS present FROM {SES}" for m, c in
        (("audio", "has_audio"), ("visual", "has_visual"), ("text", "has_transcript"), ("image", "false"), ("graph", "false"))) + ")", "dataset_index")
add("JN17_feature_choice", lambda t: ds.feature_choice(idx(t), t.dataset_index.select("participant_id", "modality", (F.length("file_path") % 3).alias("priority"), F.col("file_path").alias("path"))),
    "SELECT participant_id, modality, arg_min(file_path, (length(file_path) % 3, file_path)) AS path FROM dataset_index GROUP BY 1, 2", "dataset_index")
add("SRC8_best_file", lambda t: ds.best_file(t.dataset_index.withColumn("file_path", F.when(F.col("transcript_length") % 2 == 0, F.concat("file_path", F.lit("_transcript.csv"))).otherwise(F.col("file_path")))),
    "SELECT participant_id, modality, arg_min(p, (CASE WHEN modality = 'transcript' AND p NOT LIKE '%transcript%' THEN 1 ELSE 0 END, p)) AS file_path FROM (SELECT participant_id, modality, "
    "CASE WHEN transcript_length % 2 = 0 THEN file_path || '_transcript.csv' ELSE file_path END AS p FROM dataset_index) GROUP BY 1, 2", "dataset_index")
add("SRC12_dataset_concat", lambda t: t.dataset_index.filter("dataset = 'dvlog'").select("participant_id", "dataset", "split").unionByName(
        t.dataset_index.filter("dataset <> 'dvlog'").select("participant_id", "dataset", "label"), allowMissingColumns=True),
    "SELECT participant_id, dataset, split, NULL AS label FROM dataset_index WHERE dataset = 'dvlog' UNION ALL SELECT participant_id, dataset, NULL, label FROM dataset_index WHERE dataset <> 'dvlog'", "dataset_index")
add("SRC15_participant_ids", lambda t: t.dataset_index.filter("dataset = 'dvlog'").select("participant_id").distinct().orderBy("participant_id"),
    "SELECT DISTINCT participant_id FROM dataset_index WHERE dataset = 'dvlog'", "dataset_index")
add("SNK5_metadata_tables", lambda t: ds.first_per(t.dataset_index, ["participant_id"], ["file_path"], ["dataset", "label", "language"]),
    "SELECT participant_id, arg_min(dataset, file_path) AS dataset, arg_min(label, file_path) AS label, arg_min(language, file_path) AS language FROM dataset_index GROUP BY 1", "dataset_index")

# --- sets -----------------------------------------------------------------------------------------
ASSIGNED = "SELECT CAST(conv_id % 40 AS VARCHAR) AS participant_id, CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 < 9 THEN 'dev' ELSE 'test' END AS split, CASE WHEN turn % 3 = 0 THEN 'normal' ELSE 'depression' END AS label, 'file' || (turn % 2) AS source FROM (SELECT conv_id + turn AS conv_id, turn FROM conversations)"


def assigned(t):
    return t.conversations.selectExpr("conv_id + turn AS c", "turn").selectExpr(
        "CAST(c % 40 AS STRING) AS participant_id", "CASE WHEN c % 10 < 7 THEN 'train' WHEN c % 10 < 9 THEN 'dev' ELSE 'test' END AS split",
        "CASE WHEN turn % 3 = 0 THEN 'normal' ELSE 'depression' END AS label", "concat('file', turn % 2) AS source")


def moved(t):
    """Split assignments in which some participants sit in two splits."""
    return t.conversations.selectExpr("CAST(conv_id AS STRING) AS participant_id", "CASE WHEN (conv_id + turn) % 10 < 8 THEN 'train' WHEN (conv_id + turn) % 10 < 9 THEN 'dev' ELSE 'test' END AS split",
                                      "CASE WHEN (conv_id + turn) % 9 = 0 THEN 'normal' ELSE 'depression' END AS label", "concat('file', turn % 2) AS source")


MOVED = ("(SELECT CAST(conv_id AS VARCHAR) AS participant_id, CASE WHEN (conv_id + turn) % 10 < 8 THEN 'train' WHEN (conv_id + turn) % 10 < 9 THEN 'dev' ELSE 'test' END AS split, "
         "CASE WHEN (conv_id + turn) % 9 = 0 THEN 'normal' ELSE 'depression' END AS label FROM conversations)")
add("SET1_split_overlap", lambda t: ds.split_overlap(moved(t)),
    " UNION ALL ".join(f"SELECT participant_id, '{a}/{b}' AS pair FROM (SELECT participant_id FROM {MOVED} WHERE split = '{a}' INTERSECT SELECT participant_id FROM {MOVED} WHERE split = '{b}')"
                       for a, b in (("train", "dev"), ("train", "test"), ("dev", "test"))))
add("SET2_unassigned", lambda t: t.dataset_index.select("participant_id").distinct().subtract(moved(t).filter("split <> 'train'").select("participant_id")),
    f"SELECT participant_id FROM dataset_index EXCEPT SELECT participant_id FROM {MOVED} WHERE split <> 'train'", "dataset_index")
add("SET3_first_per_session", lambda t: ds.first_per(t.dataset_index, ["session_id"], ["file_path"], ["participant_id", "file_path"]),
    "SELECT session_id, arg_min(participant_id, file_path) AS participant_id, min(file_path) AS file_path FROM dataset_index GROUP BY 1", "dataset_index")
add("SET4_duplicate_session", lambda t: ds.duplicates(t.dataset_index, ["participant_id", "session_id"]),
    "SELECT participant_id, session_id, count(*) AS n FROM dataset_index GROUP BY 1, 2 HAVING count(*) > 1", "dataset_index")
add("SET5_duplicate_path", lambda t: ds.duplicates(t.pages.select(F.regexp_replace("url", "/[0-9]+.*$", "").alias("file_path")), ["file_path"]),
    r"SELECT file_path, count(*) AS n FROM (SELECT regexp_replace(url, '/[0-9]+.*$', '') AS file_path FROM pages) GROUP BY 1 HAVING count(*) > 1")
add("SET6_duplicate_content", lambda t: ds.duplicates(t.documents.select(F.sha2("text", 256).alias("digest")), ["digest"]),
    "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
add("SET7_duplicate_in_split", lambda t: ds.duplicates(moved(t), ["participant_id", "split"]),
    f"SELECT participant_id, split, count(*) AS n FROM {MOVED} GROUP BY 1, 2 HAVING count(*) > 1")
add("SET8_duplicate_entity", lambda t: ds.duplicates(t.lineitem.select(F.lit("Prediction").alias("label"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("natural_key")), ["label", "natural_key"]),
    "SELECT 'Prediction' AS label, l_orderkey || '-' || l_linenumber AS natural_key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add("SET9_duplicate_nodes", lambda t: ds.duplicates(t.node, ["node_id"]), "SELECT node_id, count(*) AS n FROM node GROUP BY 1 HAVING count(*) > 1", "node")
add("SET10_duplicate_files", lambda t: ds.duplicates(t.documents.select("source", F.length("text").alias("size")), ["source", "size"]),
    "SELECT source, length(text) AS size, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
add("SET11_split_leakage", lambda t: ds.split_leakage(moved(t)),
    f"SELECT participant_id, count(DISTINCT split) AS splits FROM {MOVED} GROUP BY 1 HAVING count(DISTINCT split) > 1")
add("SET12_conflicting_labels", lambda t: ds.conflicting_labels(moved(t), "source"),
    f"SELECT participant_id, min(label) || ' vs ' || max(label) AS conflict FROM {MOVED} GROUP BY 1 HAVING count(DISTINCT label) > 1")
add("DQ16_split_summary", lambda t: ds.split_summary(moved(t).filter("split <> 'train' OR participant_id <> '3'"), t.dataset_index),
    f"SELECT *, overlapping = 0 AS valid FROM (SELECT count(CASE WHEN tr THEN 1 END) AS train_count, count(CASE WHEN de THEN 1 END) AS dev_count, count(CASE WHEN te THEN 1 END) AS test_count, count(CASE WHEN n > 1 THEN 1 END) AS overlapping, "
    f"(SELECT count(DISTINCT participant_id) FROM dataset_index WHERE participant_id NOT IN (SELECT participant_id FROM {MOVED} WHERE split <> 'train' OR participant_id <> '3')) AS unassigned "
    f"FROM (SELECT participant_id, bool_or(split = 'train') AS tr, bool_or(split = 'dev') AS de, bool_or(split = 'test') AS te, count(DISTINCT split) AS n FROM {MOVED} WHERE split <> 'train' OR participant_id <> '3' GROUP BY 1))", "dataset_index")
add("TOP9_issue_list", lambda t: ds.duplicates(t.dataset_index, ["participant_id", "session_id"]),
    "SELECT participant_id, session_id, count(*) AS n FROM dataset_index GROUP BY 1, 2 HAVING count(*) > 1", "dataset_index")
add("TOP9_capped_issue_list", lambda t: ds.duplicates(t.dataset_index, ["participant_id", "session_id"]).orderBy("participant_id").limit(20),
    "SELECT participant_id, session_id, count(*) AS n FROM dataset_index GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY participant_id LIMIT 20", "dataset_index")

# --- scores and scaling ---------------------------------------------------------------------------
add("MTH1_zscore_outliers", lambda t: ds.zscore_outliers(t.checkin.select("id", "value"), "value").select("id", r9("z").alias("z"), "outlier"),
    f"SELECT id, {q9('abs((value - m) / (s + 1e-8))')} AS z, n >= 3 AND abs((value - m) / (s + 1e-8)) > 3 AS outlier FROM checkin, (SELECT avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM checkin)", "checkin")
COLS = ["quality_score", "duration", "k2"]
add("MTH3_correlations", lambda t: rounded_all(ds.correlations(t.session.withColumn("k2", F.col("offline_mode").cast("double")), COLS)),
    " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, {q9(f'corr({a}, {b})')} AS r FROM (SELECT *, CAST(offline_mode AS DOUBLE) AS k2 FROM session)" for i, a in enumerate(COLS) for b in COLS[i:]), "session")
SCALE = {"minmax": "(value - a) / (b - a + 1e-8)", "robust": "(value - md) / (q3 - q1 + 1e-8)", "quantile": "greatest(0e0, least(1e0, (value - lo) / (hi - lo + 1e-8)))", "zscore": "(value - m) / (s + 1e-8)"}
STATS = ("(SELECT min(value) AS a, max(value) AS b, median(value) AS md, quantile_cont(value, 25e-2) AS q1, quantile_cont(value, 75e-2) AS q3, quantile_cont(value, 5e-2) AS lo, quantile_cont(value, 95e-2) AS hi, "
         "avg(value) AS m, stddev_pop(value) AS s FROM checkin)")
for _m, _e in SCALE.items():
    add(f"MTH6_{_m}_scaling", lambda t, m=_m: ds.scaled(t.checkin.select("id", "value"), "value", m).select("id", r9("scaled").alias("scaled")), f"SELECT id, {q9(_e)} AS scaled FROM checkin, {STATS}", "checkin")
add("MTH9_sync_score", lambda t: t.checkin.select("id", ql.sync_score(F.col("value"), F.col("k") * 20, F.col("k") % 5 * 300).alias("sync")),
    f"SELECT id, CASE WHEN value <= 0 THEN 0e0 ELSE {q4('6e-1 * (least(k * 20, value * 15) / greatest(value * 15, 1)) + 4e-1 * CASE WHEN k % 5 > 0 THEN least(k % 5 * 300, value * 30) / greatest(value * 30, 1) ELSE 1e0 END')} END AS sync FROM checkin", "checkin")


def durations(t):
    return F.array(F.when(F.col("k") % 4 != 0, F.col("value")), F.when(F.col("k") % 3 != 0, F.col("value") * 0.9), F.when(F.col("k") % 5 != 0, F.col("value") + 20))


AL = ("SELECT id, list_filter([CASE WHEN k % 4 <> 0 THEN value END, CASE WHEN k % 3 <> 0 THEN value * 9e-1 END, CASE WHEN k % 5 <> 0 THEN value + 20 END], lambda x: x IS NOT NULL AND x <> 0) AS l FROM checkin")
AL = f"SELECT id, len(l) AS c, floor((list_max(l) - list_min(l)) * 1e3 + 5000001e-7) / 1e3 AS off, {q4('least(1e0, list_min(l) / list_max(l))')} AS base FROM ({AL})"
add("MTH10_alignment", lambda t: t.checkin.select("id", *[c.alias(n) for n, c in ql.alignment(durations(t)).items()]).withColumnRenamed("offset", "off"),
    f"SELECT id, CASE WHEN c >= 2 THEN off END AS off, CASE WHEN c < 2 THEN CAST(c AS DOUBLE) WHEN off > 30 THEN {q4('base * 5e-1')} ELSE base END AS score FROM ({AL})", "checkin")
add("MTH11_session_quality", lambda t: idx(t).select("participant_id", r4(ql.session_quality(F.col("quality_score"), F.col("sync_score"), F.col("has_audio"), F.col("has_visual"), F.col("has_transcript"), F.lit(True))).alias("overall")),
    f"SELECT participant_id, {q4('least(1e0, (25e-2 * (CASE WHEN has_audio THEN quality_score ELSE 0e0 END) + 2e-1 * (CASE WHEN has_visual THEN quality_score ELSE 0e0 END) + 25e-2 * (CASE WHEN has_transcript THEN quality_score ELSE 0e0 END) + 15e-2 * sync_score + 15e-2 * 1e0) * (5e-1 + 5e-1 * ((has_audio::INT + has_visual::INT + has_transcript::INT) / 5e0)))')} AS overall FROM {SES}", "dataset_index")
add("MTH13_parser_quality", lambda t: t.checkin.select("id", *[c.alias(n) for n, c in ql.parser_quality(F.col("value"), F.col("k") % 3, F.col("k") % 5, F.col("k") / 100.0, F.lit(0.5), F.col("k") % 2 == 0, F.col("k") % 3 != 1, F.lit(True)).items()]),
    f"SELECT id, {q4('c')} AS metadata_completeness, {q4('(a + v + k / 1e2 + 5e-1 + c) / 5')} AS overall FROM (SELECT id, k, CASE WHEN k % 2 = 0 AND value <> 0 THEN 1e0 ELSE 0e0 END AS a, CASE WHEN k % 3 <> 1 AND k % 3 <> 0 THEN 1e0 ELSE 0e0 END AS v, "
    "((value <> 0)::INT + (k % 3 <> 0)::INT + (k % 5 <> 0)::INT) / CAST((k % 2 = 0)::INT + (k % 3 <> 1)::INT + 1 AS DOUBLE) AS c FROM checkin)", "checkin")
add("MTH14_sample_quality", lambda t: t.checkin.select("id", *[c.alias(n) for n, c in ql.sample_quality(F.col("k") % 5 != 0, F.when(F.col("k") % 3 == 0, "unknown").otherwise("normal"), F.col("k") % 6).items()]),
    f"SELECT id, c AS corruption, l AS confidence, {q4('(e + l + c + e) / 4')} AS overall FROM (SELECT id, CASE WHEN k % 5 <> 0 THEN 1e0 ELSE 0e0 END AS e, CASE WHEN k % 3 = 0 THEN 3e-1 ELSE 1e0 END AS l, greatest(0e0, 1 - (k % 6) * 25e-2) AS c FROM checkin)", "checkin")
add("MTH18_sync_by_session", lambda t: ds.sync_by_session(t.conversations.selectExpr("conv_id AS session_id", "text"), t.conversations.groupBy(F.col("conv_id").alias("session_id")).agg((F.count("*") * 12.0).alias("seconds"))),
    f"SELECT conv_id AS session_id, count(*) * 12e0 AS seconds, CAST(sum(length(text)) AS BIGINT) AS chars, {q4('6e-1 * (least(sum(length(text)), count(*) * 12e0 * 15) / greatest(count(*) * 12e0 * 15, 1)) + 4e-1')} AS sync_score FROM conversations GROUP BY 1")
add("TOP10_oversample", lambda t: ds.stratified_oversample(t.scored, "label", "doc_id").select("doc_id", "label", "copy"))
DRAW = "CAST('0x' || md5('42-{}-' || draw)[1:13] AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
add("TOP10_weighted_sample", lambda t: ds.weighted_sample(t.scored.select("doc_id", "label"), "label", "doc_id").select("draw", "label", "doc_id"),
    "SELECT draw, p.label, doc_id FROM (SELECT draw, c.label, CAST(floor(" + DRAW.format("row") + " * c.n) AS BIGINT) + 1 AS pos FROM (SELECT unnest(range(0, (SELECT count(*) FROM scored WHERE label IS NOT NULL))) AS draw) d "
    "JOIN (SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM (SELECT label, count(*) AS n FROM scored WHERE label IS NOT NULL GROUP BY 1)) c ON c.i = floor(" + DRAW.format("class") + " * c.k)) x "
    "JOIN (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS pos FROM scored) p ON p.label = x.label AND p.pos = x.pos", "scored")
add("TOP11_kfold", lambda t: ds.kfold(t.scored.select("doc_id"), "doc_id"))
add("TOP11_fold_check", lambda t: ds.kfold(t.scored.select("doc_id"), "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.count_distinct("fold").alias("folds"), F.count_if(F.col("fold").between(0, 4)).alias("within")),
    'SELECT doc_id, count(*) AS "rows", 1 AS folds, count(*) AS within FROM scored GROUP BY 1', "scored")
add("TOP12_held_out_sizes", lambda t: ds.held_out_sizes(t.dataset_index, "participant_id"),
    "SELECT participant_id AS held, count(*) AS validation_rows, (SELECT count(*) FROM dataset_index) - count(*) AS training_rows FROM dataset_index GROUP BY 1", "dataset_index")
