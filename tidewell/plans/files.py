"""File round trips: tables derived from the given ones are written, read back and checked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidewell.operators import dataset as ds
from tidewell.operators import gates as gt
from tidewell.plans.dataset import INDEX_SQL, idx
from tidewell.plans.gates import ISSUES, ROLL, every_issue
from tidewell.plans.graphs import BUILT
from tidewell.plans.registry import add
from tidewell.schemas import LEXICONS
from tidewell.session import work_folder
from tidewell.sinks import files as sink
from tidewell.sources import files as src
from tidewell.sources import headers as hd
from tidewell.sources import registry as reg

COUNTED = "SELECT modality, count(*) AS n, CAST(sum(transcript_length) AS BIGINT) AS chars FROM dataset_index GROUP BY 1"


def by_modality(df):
    return df.groupBy("modality").agg(F.count("*").alias("n"), F.sum("transcript_length").cast("long").alias("chars"))


def index_round_trip(t):
    paths = sink.export_index(t.dataset_index.select(*[c.split()[0] for c in src.INDEX_DDL.split(", ")]), work_folder(t.spark, "index"))
    return by_modality(src.dataset_index(t.spark, paths["csv"]))


add("SRC1_index_csv", index_round_trip, COUNTED, "dataset_index")
def metadata_records(t):
    return t.dataset_index.selectExpr("*", "concat(file_path, '#', modality) AS sample_id", "IF(transcript_length % 7 = 0, 0D, transcript_length / 4D) AS duration_seconds")


def metadata_rows(t):
    """All five tables, written as CSV and read again, as (table, key, field, value)."""
    tables = ds.metadata_tables(metadata_records(t))
    paths = sink.write_metadata(tables, work_folder(t.spark, "metadata"))
    keys = {"participants": "participant_id", "sessions": "session_id", "files": "sample_id", "labels": "participant_id", "languages": "participant_id"}
    out = None
    for name, path in paths.items():
        rows = t.spark.read.option("header", True).schema(", ".join(f"{c} STRING" for c in [*[c for c in tables[name].columns if c != "modality"], *(["modality"] if name == "files" else [])])).csv(path)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in rows.columns if c != keys[name]]))
        part = rows.select(F.lit(name).alias("table_name"), F.col(keys[name]).alias("key"), cells.alias("c")).select("table_name", "key", "c.*")
        out = part if out is None else out.unionAll(part)
    return out


FIRST_OF = "arg_min({0}, file_path) AS {0}"
PEOPLE = f"SELECT participant_id, {', '.join(FIRST_OF.format(c) for c in ('dataset', 'label', 'language'))} FROM dataset_index GROUP BY 1"
FILED = ("SELECT file_path || '#' || modality AS sample_id, modality, participant_id, file_path, CASE WHEN transcript_length % 7 = 0 OR transcript_length = 0 THEN NULL ELSE CAST(transcript_length / 4e0 AS VARCHAR) END AS duration_seconds FROM dataset_index")


def cells_sql(table, key, fields, rows):
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, {key} AS key, '{f}' AS field, {f} AS value FROM ({rows})" for f in fields)


add("SNK5_written_tables", metadata_rows, " UNION ALL ".join((
    cells_sql("participants", "participant_id", ("dataset", "label", "language"), PEOPLE),
    cells_sql("sessions", "session_id", ("participant_id", "dataset"), "SELECT session_id, arg_min(participant_id, file_path) AS participant_id, arg_min(dataset, file_path) AS dataset FROM dataset_index GROUP BY 1"),
    cells_sql("files", "sample_id", ("modality", "participant_id", "file_path", "duration_seconds"), FILED),
    cells_sql("labels", "participant_id", ("label",), PEOPLE), cells_sql("languages", "participant_id", ("language",), PEOPLE))), "dataset_index")
add("SNK1_index_export", lambda t: by_modality(t.spark.read.parquet(sink.export_index(t.dataset_index, work_folder(t.spark, "index"))["parquet"])), COUNTED, "dataset_index")


def split_files(t):
    """Official split files per split, with the id written as ``<id>_P``."""
    folder = work_folder(t.spark, "splits")
    rows = idx(t).selectExpr("participant_id", "split", "CASE label WHEN 'depression' THEN '1' WHEN 'normal' THEN '0' ELSE '' END AS y")
    for name in ("train", "dev", "test"):
        part = rows.filter(F.col("split") == name).selectExpr("concat(participant_id, '_P') AS Participant_ID", "y AS PHQ8_Binary", "'1' AS Gender")
        part.write.option("header", True).option("emptyValue", "").csv(f"{folder}/raw_{name}")
        named = t.spark.read.text(f"{folder}/raw_{name}")
        named.withColumn("split_file", F.lit(f"{name}_split")).write.mode("append").partitionBy("split_file").text(f"{folder}/parts")
    return folder


LABELS_SQL = f"SELECT participant_id, split, label FROM ({INDEX_SQL}) WHERE split <> 'unknown'"


def official(t):
    """The split is read from the name of the folder part that stands for the file."""
    folder = split_files(t)
    lines = t.spark.read.text(f"{folder}/parts").select("value", F.col("split_file").alias("source_file"), F.concat("split_file", F.col("_metadata.file_path")).alias("file"))
    rows = src._by_header(lines, ("Participant_ID", "participant_id"), {"raw_label": ("PHQ8_Binary", "label"), "gender": ("Gender",)})
    return rows.select(src.participant_name(F.col("key")).alias("participant_id"), F.regexp_extract("source_file", "^[a-z]+", 0).alias("split"),
                       F.when(F.col("raw_label").isNull(), "unknown").otherwise(src.label_class(F.col("raw_label"))).alias("label"))


add("SRC2_official_labels", official, LABELS_SQL, "dataset_index")


def numbered(t):
    path = work_folder(t.spark, "numbered")
    idx(t).selectExpr("participant_id AS index", "label", "audio_length AS duration", "'f' AS gender", "IF(split = 'dev', 'validation', split) AS fold").write.option("header", True).csv(path)
    return src.numbered_labels(t.spark, path).selectExpr("participant_id", "label", "split")


add("SRC3_numbered_labels", numbered, f"SELECT participant_id, label, split FROM ({INDEX_SQL})", "dataset_index")


def write_pieces(t, lines, head, folder):
    """A file for up to 1000 turns of a conversation, so a long one is several files; a folder for a thousand conversations.

    ``lines`` has ``conv_id, turn, l``. Many small files cost by their number: the rows are dealt to a fixed count of tasks, and each
    task writes its files itself, without a folder of its attempt that the driver moves.
    """
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.withColumn("piece", F.expr("turn DIV 1000")).repartition(tasks, "conv_id", "piece")
    body = rows.groupBy("conv_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]), "\n").alias("b"))
    name = F.concat(F.lit("shard="), F.expr("conv_id DIV 1000").cast("string"), F.lit("/conv_id="), F.col("conv_id").cast("string"), F.lit("-"), F.col("piece").cast("string"), F.lit(".txt"))
    sink.write_blobs(body.select(name.alias("name"), F.concat(F.lit(head), "b", F.lit("\n")).cast("binary").alias("content")), folder)
    return folder


def transcript_files(t):
    line = F.concat_ws("\t", F.col("turn").cast("string"), (F.col("turn") + 1).cast("string"), "role", F.regexp_replace("text", "[\t\r\n]+", " "))
    return write_pieces(t, t.conversations.filter("text <> ''").select("conv_id", "turn", line.alias("l")), "start_time\tstop_time\tspeaker\tvalue\n", work_folder(t.spark, "transcripts"))


add("SRC4_transcript_csv", lambda t: src.transcripts(t.spark, transcript_files(t), "*.txt").groupBy("speaker").agg(F.count("*").alias("n"), F.sum("start_time").alias("starts")),
    "SELECT role AS speaker, count(*) AS n, CAST(sum(turn) AS DOUBLE) AS starts FROM conversations WHERE text <> '' GROUP BY 1")


def quoted_transcripts(t):
    """All conversations as comma files of up to 1000 turns, every text quoted, line breaks and quotes inside."""
    text = F.concat(F.lit('"'), F.replace(F.concat(F.lit('He said, "'), "text", F.lit('"\nand left')), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("turn").cast("string"), (F.col("turn") + 2).cast("string"), "role", text)
    return write_pieces(t, t.conversations.select("conv_id", "turn", line.alias("l")), "Start_Time,Stop_Time,Speaker,Text\n", work_folder(t.spark, "quoted"))


SPOKEN = r"""trim(regexp_replace('He said, "' || text || '" and left', '\s+', ' ', 'g'))"""
add("SRC4_quoted_transcripts", lambda t: src.transcripts(t.spark, quoted_transcripts(t), "*.txt").select(F.regexp_extract("file", r"conv_id=(-?\d+)", 1).cast("long").alias("conv_id"), F.col("ord").cast("long").alias("ord"), "speaker", "start_time", "stop_time", F.md5("text").alias("text_md5"), "duration"),
    f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role AS speaker, CAST(turn AS DOUBLE) AS start_time, turn + 2e0 AS stop_time, md5({SPOKEN}) AS text_md5, 2e0 AS duration FROM conversations")


def plain(t):
    folder = work_folder(t.spark, "plain")
    t.documents.select(F.regexp_replace("text", "[\r\n]+", " ").alias("value"), "source").write.partitionBy("source").text(folder)
    return src.plain_transcripts(t.spark, folder).groupBy("speaker").agg(F.sum("ord").alias("ords"))


add("SRC5_plain_transcripts", plain, "SELECT 'unknown' AS speaker, 0 AS ords")
add("SRC6_listing", lambda t: src.listing(t.spark, transcript_files(t)).groupBy("modality").agg(F.count("*").alias("n")), "SELECT 'text' AS modality, count(*) AS n FROM (SELECT DISTINCT conv_id, turn // 1000 FROM conversations WHERE text <> '')")
add("SRC6_classified_names", lambda t: t.pages.select("page_id", src.classify(F.concat(F.element_at(F.split("url", "/"), -1), F.expr("CASE page_id % 6 WHEN 0 THEN '_CLNF_AUs.txt' WHEN 1 THEN '.wav' WHEN 2 THEN '.mp4' WHEN 3 THEN '_TRANSCRIPT.csv' WHEN 4 THEN '_COVAREP.csv' ELSE '.bin' END"))).alias("kind")),
    "SELECT page_id, CASE WHEN regexp_matches(lower(url), '(clnf|hog|gaze|pose|_aus)[^/]*$') THEN 'facial_features' ELSE CASE page_id % 6 WHEN 0 THEN 'facial_features' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'transcript' WHEN 4 THEN 'audio_features' ELSE 'other' END END AS kind FROM pages")
def interview_tree(t):
    """Folders ``<conv>_P/participant_data/text`` with all texts, a file for up to 1000 turns, and official split files for up to 1000 ids."""
    folder = work_folder(t.spark, "interviews")
    lines = t.conversations.filter("text <> ''").select("conv_id", F.expr("turn DIV 1000").alias("piece"), F.struct("turn", "text").alias("l"))
    texts = lines.groupBy("conv_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]), "\n").alias("b"))
    sink.write_blobs(texts.select(F.concat(F.col("conv_id").cast("string"), F.lit("_P/participant_data/text/"), F.col("piece").cast("string"), F.lit(".txt")).alias("name"), F.col("b").cast("binary").alias("content")), folder)
    rows = idx(t).filter("split IN ('train', 'dev', 'test')").selectExpr("split", "CAST(participant_id AS BIGINT) DIV 1000 AS piece", "concat(participant_id, '_P,', CASE label WHEN 'depression' THEN '1' WHEN 'normal' THEN '0' ELSE '' END, ',1') AS line")
    files = rows.groupBy("split", "piece").agg(F.concat(F.lit("Participant_ID,PHQ8_Binary,Gender\n"), F.array_join(F.collect_list("line"), "\n")).alias("b"))
    sink.write_blobs(files.select(F.concat(F.lit("splits/"), "split", F.lit("_split_"), F.col("piece").cast("string"), F.lit(".csv")).alias("name"), F.col("b").cast("binary").alias("content")), folder)
    return folder


def numbered_tree(t):
    """Array files of all groups of vectors and a label table for two groups of three."""
    folder = array_folder(t)
    samples(t).filter("g % 3 < 2").selectExpr("CAST(g AS STRING) AS index", "IF(g % 3 = 0, '1', '0') AS label", "IF(g % 2 = 0, 'valid', 'train') AS fold", "n / 10D AS duration", "'f' AS gender").write.option("header", True).csv(f"{folder}/labels.csv")
    return folder


SAMPLE = ("sample_id", "participant_id", "session_id", "dataset", "modality", "label", "split", "language")
INTERVIEWED = (f"SELECT p || '_text_' || piece AS sample_id, p AS participant_id, p AS session_id, 'daic_woz' AS dataset, 'text' AS modality, coalesce(label, 'unknown') AS label, split, 'en' AS language "
               f"FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS p, turn // 1000 AS piece FROM conversations WHERE text <> '') LEFT JOIN ({LABELS_SQL}) ON participant_id = p")


def numbered_sql():
    return ("SELECT p || '_' || m AS sample_id, p AS participant_id, p AS session_id, 'dvlog' AS dataset, m AS modality, CASE g % 3 WHEN 0 THEN 'depression' WHEN 1 THEN 'normal' ELSE 'unknown' END AS label, "
            f"CASE WHEN g % 3 < 2 THEN CASE WHEN g % 2 = 0 THEN 'dev' ELSE 'train' END END AS split, 'en' AS language FROM {GROUPS}, (VALUES ('audio'), ('visual')) v(m) WHERE m = 'audio' OR g % 3 <> 0")


add("SRC7_adapter_discovery", lambda t: reg.discover(t.spark, "daic_woz", interview_tree(t)).select(*SAMPLE), INTERVIEWED, "dataset_index")


def parsed(t):
    files = t.dataset_index.selectExpr("participant_id", "IF(modality = 'facial_features', 'video', modality) AS modality", "file_path")
    lengths = t.dataset_index.groupBy("participant_id").agg(F.max("audio_length").alias("audio_length"), F.lit(0.0).alias("video_length"), F.max("transcript_length").alias("transcript_length"), F.max(F.col("audio_length") * 0.9).alias("last_stop"), F.lit(0.5).alias("transcript_quality"))
    return src.participants(files, lengths)


add("SRC13_participant_parse", lambda t: parsed(t).select("participant_id", "has_audio", "has_video", "has_transcript", "files", "missing_files"),
    "SELECT participant_id, bool_or(modality = 'audio') AS has_audio, bool_or(modality = 'facial_features') AS has_video, bool_or(modality = 'transcript') AS has_transcript, count(*) AS files, "
    "concat_ws(',', CASE WHEN NOT bool_or(modality = 'audio') THEN 'audio' END, CASE WHEN NOT bool_or(modality = 'facial_features') THEN 'video' END, CASE WHEN NOT bool_or(modality = 'transcript') THEN 'transcript' END) AS missing_files FROM dataset_index GROUP BY 1", "dataset_index")
add("SRC14_array_participants", lambda t: t.embeddings.groupBy((F.col("vec_id") % 100).alias("participant_id")).agg(F.max(F.size("embedding")).cast("long").alias("audio_length"), F.count("*").alias("arrays")),
    "SELECT vec_id % 100 AS participant_id, max(len(embedding)) AS audio_length, count(*) AS arrays FROM embeddings GROUP BY 1")


def metrics(t):
    folder = work_folder(t.spark, "runs")
    t.labels.groupBy(F.concat(F.lit("EXP"), F.col("quality").cast("string")).alias("run")).agg(F.avg("toxic").alias("f1"), F.count("*").alias("n")).repartition("run").write.partitionBy("run").json(folder)
    return src.run_metrics(t.spark, f"{folder}/run=EXP*/*.json").selectExpr("replace(run, 'run=', '') AS run", "n")


add("SRC9_run_metrics", metrics, "SELECT 'EXP' || quality AS run, count(*) AS n FROM labels GROUP BY 1")


def stored_or_rebuilt(t):
    folder = work_folder(t.spark, "fallback")
    paths = sink.export_index(t.dataset_index.select(*[c.split()[0] for c in src.INDEX_DDL.split(", ")]), folder)
    rebuilt = src.sessions_or_index(t.spark, f"{folder}/missing.parquet", paths["csv"])
    stored = src.sessions_or_index(t.spark, sink.save_sessions(rebuilt, folder), paths["csv"])
    return stored.groupBy("label", "has_audio").agg(F.count("*").alias("n"))


add("SRC10_sessions_or_index", stored_or_rebuilt, f"SELECT label, has_audio, count(*) AS n FROM ({INDEX_SQL}) GROUP BY 1, 2", "dataset_index")
add("SNK2_sessions_parquet", lambda t: t.spark.read.parquet(sink.save_sessions(idx(t), work_folder(t.spark, "sessions"))).select("participant_id", "split", "quality_score"),
    f"SELECT participant_id, split, quality_score FROM ({INDEX_SQL})", "dataset_index")


def lexicon_terms(t):
    """Category files made of the part names, merged over the default lists."""
    folder = work_folder(t.spark, "lexicons")
    t.part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("value"), F.lower(F.split("p_type", " ")[0]).alias("category")).distinct().write.partitionBy("category").text(folder)
    lines = t.spark.read.text(folder).select("category", F.lower("value").alias("term"))
    defaults = t.spark.createDataFrame([(c, x) for c, xs in LEXICONS.items() for x in xs], "category STRING, term STRING")
    return lines.unionByName(defaults.join(lines.select("category").distinct(), "category", "left_anti")).groupBy("category").agg(F.count("*").alias("n"))


add("SRC11_lexicon_terms", lexicon_terms,
    "SELECT category, count(*) AS n FROM (SELECT DISTINCT lower(string_split(p_type, ' ')[1]) AS category, p_brand || ' ' || p_size AS v FROM part) GROUP BY 1 UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', {len(x)})" for c, x in LEXICONS.items()) + ") v")


def manifest(t):
    paths = sink.export_training(idx(t), work_folder(t.spark, "training"), {"seed": 42})
    return t.spark.read.parquet(paths["parquet"]).groupBy("split").agg(F.count("*").alias("n"))


add("SNK3_training_manifest", manifest, f"SELECT split, count(*) AS n FROM ({INDEX_SQL}) GROUP BY 1", "dataset_index")
add("SNK4_sample_export", lambda t: t.spark.read.json(sink.export_samples(t.dataset_index.withColumn("sample_id", F.col("file_path")), work_folder(t.spark, "samples"))["json"]).select("sample_id", "modality", "label"),
    "SELECT file_path AS sample_id, modality, label FROM dataset_index", "dataset_index")


def text_export(t):
    from tidewell.operators.transcripts import text_features

    rows = text_features(t.conversations.withColumn("row", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "row")
    path = sink.write_formats(rows, work_folder(t.spark, "text"), "features", ("parquet",))["parquet"]
    return t.spark.read.parquet(path).select("row", "digest")


add("SNK6_text_feature_export", text_export, "SELECT conv_id || '/' || turn AS row, sha256(text) AS digest FROM conversations".replace("AS row", 'AS "row"'))


def audit(t):
    path = work_folder(t.spark, "audit")
    rows = t.checkin.selectExpr("event_type AS operation", "CAST(id AS STRING) AS entity_id", "CAST(ts AS TIMESTAMP) AS created_at")
    sink.append_audit(rows.filter("id % 2 = 0"), path)
    sink.append_audit(rows.filter("id % 2 = 1"), path)
    return sink.recent_audit(t.spark, path, 100).select("operation", "entity_id")


add("SNK10_audit_log", audit, "SELECT event_type AS operation, CAST(id AS VARCHAR) AS entity_id FROM checkin ORDER BY ts DESC LIMIT 100", "checkin")


def gate_report(t):
    path = work_folder(t.spark, "gates")
    sink.write_gate_report(gt.roll_up(every_issue(t)), path)
    return t.spark.read.json(path).select("gate", "status", "issues", "approved")


SOME = f"(SELECT * FROM ({ROLL}) WHERE issues > 0)"
add("SNK11_gate_report", gate_report, f"SELECT gate, status, issues, (SELECT count(CASE WHEN status = 'failed' THEN 1 END) = 0 FROM {SOME}) AS approved FROM {SOME}", "dataset_index")
SCRIPT_DDL = "participant_id STRING, ord BIGINT, start_time DOUBLE, speaker STRING, text STRING, relative_time DOUBLE"
add("SNK13_transcript_export", lambda t: t.spark.read.schema(SCRIPT_DDL).json(sink.export_transcripts(t.conversations.selectExpr("CAST(conv_id AS STRING) AS participant_id", "turn AS ord", "CAST(turn AS DOUBLE) AS start_time", "role AS speaker", "text"), work_folder(t.spark, "script"))).groupBy("speaker").agg(F.count("*").alias("n")),
    "SELECT role AS speaker, count(*) AS n FROM conversations GROUP BY 1")


def vector_store(t):
    path = work_folder(t.spark, "vectors")
    sink.write_vectors(t.embeddings.selectExpr("CAST(vec_id AS STRING) AS participant_id", "CAST(vec_id AS STRING) AS session_id", "concat('t', label % 3) AS feature_type", "embedding AS v"), path)
    return sink.read_vectors(t.spark, path, "t1").selectExpr("participant_id", "CAST(embedding_dim AS BIGINT) AS embedding_dim")


add("SNK14_vector_store", vector_store, "SELECT CAST(vec_id AS VARCHAR) AS participant_id, len(embedding) AS embedding_dim FROM embeddings WHERE label % 3 = 1")


def issue_tables(t):
    path = sink.write_formats(every_issue(t), work_folder(t.spark, "issues"), "issues", ("parquet",), ("gate",))["parquet"]
    return t.spark.read.parquet(path).groupBy("gate", "check").agg(F.count("*").alias("n"))


add("SNK15_issue_tables", issue_tables, f"SELECT gate, \"check\", count(*) AS n FROM ({ISSUES}) GROUP BY 1, 2", "dataset_index")


def graph_files(t):
    from tidewell.operators import graph as gr

    paths = sink.write_graph(gr.nodes_of(gr.build_edges(idx(t))), gr.build_edges(idx(t)), work_folder(t.spark, "graph"))
    return t.spark.read.text(paths["graphml"]).groupBy(F.regexp_extract("value", "^<([a-z/]+)", 1).alias("element")).agg(F.count("*").alias("n"))


ENDS = f"(SELECT src AS e FROM ({BUILT}) UNION SELECT dst FROM ({BUILT}))"
add("SNK7_graph_files", graph_files,
    f"SELECT 'node' AS element, count(*) AS n FROM {ENDS} UNION ALL SELECT 'edge', count(*) FROM ({BUILT}) UNION ALL SELECT * FROM (VALUES ('graphml', 1), ('/graph', 1)) v", "dataset_index")


def presence(t):
    folder = work_folder(t.spark, "presence")
    paths = sink.export_index(t.dataset_index, folder)
    return sink.outputs_present(t.spark, {**paths, "manifest": f"{folder}/none.json"}, t.embeddings, t.dataset_index)


add("DQ17_outputs_present", presence, "SELECT * FROM (VALUES ('csv', true), ('json', true), ('parquet', true), ('manifest', false), ('feature_coverage', (SELECT count(*) FROM embeddings) >= 1)) v(\"check\", passed)")
add("DQ8_export_gate", lambda t: gt.export_gate(t.dataset_index, t.dataset_index.filter("modality = 'transcript'")),
    "SELECT participant_id, 'export' AS gate, CASE WHEN bool_or(modality = 'transcript') THEN 'passed' ELSE 'warning' END AS status FROM dataset_index GROUP BY 1", "dataset_index")
add("AGG28_version_record", lambda t: src.version_record(t.pages.select(F.col("url").alias("file_path"), F.length("html").alias("size")), "pages").select("dataset_hash", "dataset_source"),
    "SELECT sha256(count(*) || ':' || " + " || ':' || ".join(f"coalesce(sum(('0x' || substr(e, {1 + 13 * k}, 13))::BIGINT), 0)" for k in range(4)) + ") AS dataset_hash, 'pages' AS dataset_source "
    "FROM (SELECT sha256(url || '|' || length(html)) AS e FROM pages)")
add("AGG29_reproducibility", lambda t: sink.reproducibility_row(t.spark, {"seed": 42, "alpha": 0.3}).crossJoin(t.documents.agg(F.count("*").alias("n"))).select("config_hash", "n"),
    """SELECT substr(sha256('{"alpha": 0.3, "seed": 42}'), 1, 16) AS config_hash, count(*) AS n FROM documents""")


def halves(t):
    def risky(value):
        return 100 // (int(value) % 7)

    return reg.map_rows(t.checkin, "id", "k", risky)


add("UDF1_failure_capture", halves,
    "SELECT CAST(id AS VARCHAR) AS key, CASE WHEN k % 7 <> 0 THEN CAST(100 // (k % 7) AS VARCHAR) END AS result, CASE WHEN k % 7 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM checkin", "checkin")


def mean_pair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [float(len(s)), float(len(s.split()))])


add("UDF3_embedding_hook", lambda t: reg.embed(t.conversations, "text", mean_pair).selectExpr("conv_id", "turn", "CAST(embedding[0] AS DOUBLE) AS chars"),
    "SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS chars FROM conversations")


# --- headers of media and array files ---------------------------------------------------------------
def little(number, size):
    """A number as little-endian hex digits."""
    digits = F.lpad(F.hex(F.lit(number) if isinstance(number, int) else number), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def ascii_hex(text):
    return F.lit(text.encode().hex())


def samples(t):
    """Vectors in groups of 50 ids as 16-bit samples: ``g, arrays, n, body`` (hex)."""
    one = F.transform("embedding", lambda x: little(F.pmod(F.floor(x * 1000), F.lit(65536)), 2))
    rows = t.embeddings.select(F.expr("vec_id DIV 50").alias("g"), F.array_join(one, "").alias("h"), F.size("embedding").alias("k"))
    return rows.groupBy("g").agg(F.count("*").alias("arrays"), F.sum(F.greatest("k", F.lit(0))).alias("n"), F.array_join(F.collect_list("h"), "").alias("body"))


def sound_files(t):
    """Audio files made of the vectors: a chunk before the format, odd rates, other forms, no samples, cut headers."""
    rows = samples(t).withColumns({"rate": F.expr("CASE g % 5 WHEN 1 THEN 12345 WHEN 3 THEN 8000 ELSE 16000 END"), "body": F.expr("IF(g % 5 = 3, '', body)")})
    rows = rows.withColumn("bytes", F.length("body") / 2).withColumn("bytes", F.col("bytes").cast("long")).withColumn("twice", F.col("rate") * 2)
    head = F.concat(F.when(F.expr("g % 5 = 2"), ascii_hex("RIFX")).otherwise(ascii_hex("RIFF")), little(36, 4), ascii_hex("WAVE"), ascii_hex("LIST"), little(5, 4), ascii_hex("notes\0"))
    form = F.concat(ascii_hex("fmt "), little(16, 4), little(1, 2), little(1, 2), little("rate", 4), little("twice", 4), little(2, 2), little(16, 2))
    whole = F.concat(head, form, ascii_hex("data"), little("bytes", 4), "body")
    made = rows.select(F.concat("g", F.lit("_AUDIO.wav")).alias("name"), F.unhex(F.when(F.expr("g % 5 = 4"), F.substring(whole, 1, 80)).otherwise(whole)).alias("content"))
    folder = work_folder(t.spark, "sounds")
    sink.write_blobs(made, folder)
    return folder


def media_rules(t):
    """Headers of the listed files and of one in seven that the index names but nobody wrote."""
    found = src.listing(t.spark, sound_files(t)).select("file_path", F.regexp_extract("name", "^[0-9]+", 0).alias("participant_id"))
    lost = found.filter("participant_id % 7 = 0").select(F.concat("file_path", F.lit(".lost.wav")).alias("file_path"), "participant_id")
    owners = found.unionByName(lost)
    return hd.file_issues(hd.file_errors(hd.media_headers(owners)), owners)


GROUPS = "(SELECT vec_id // 50 AS g, CAST(vec_id // 50 AS VARCHAR) AS p, count(*) AS arrays, CAST(coalesce(sum(len(embedding)), 0) AS BIGINT) AS n FROM embeddings GROUP BY 1)"
add("DQ20_media_headers", media_rules,
    " UNION ALL ".join(f"SELECT 'file' AS gate, 'audio_validation' AS check, '{severity}' AS severity, p || '{text}' AS message, p AS participant_id FROM {GROUPS} WHERE {cond}" for severity, text, cond in (
        ("warning", "_AUDIO.wav: unexpected_sample_rate:12345", "g % 5 = 1"), ("error", "_AUDIO.wav: unreadable:not a RIFF file of this kind", "g % 5 = 2"), ("warning", "_AUDIO.wav: zero_duration", "g % 5 = 3 OR (g % 5 IN (0, 1) AND n = 0)"),
        ("error", "_AUDIO.wav: unreadable:file ends inside its header", "g % 5 = 4"), ("error", "_AUDIO.wav.lost.wav: missing", "g % 7 = 0"))))
add("DQ20_audio_headers", lambda t: src.wav_header(t.spark, sound_files(t)).filter("error IS NULL").select(F.regexp_extract("file_path", "([0-9]+)_AUDIO", 1).alias("participant_id"), "channels", "sample_rate", "bit_depth", "duration_seconds"),
    "SELECT p AS participant_id, 1 AS channels, r AS sample_rate, 16 AS bit_depth, floor(CASE WHEN g % 5 = 3 THEN 0 ELSE n END / CAST(r AS DOUBLE) * 1e3 + 5000001e-7) / 1e3 AS duration_seconds "
    f"FROM (SELECT *, CASE g % 5 WHEN 1 THEN 12345 WHEN 3 THEN 8000 ELSE 16000 END AS r FROM {GROUPS}) WHERE g % 5 NOT IN (2, 4)")


def array_folder(t):
    """``<g>_acoustic.npy`` for every group, ``<g>_visual.npy`` for two groups of three, every eleventh one cut short."""
    def stored(name, first):
        head = F.concat(F.lit("{'descr': '<i2', 'fortran_order': False, 'shape': ("), first, F.lit(", 1), }\n"))
        size = little(F.length(head), 2)
        whole = F.concat(F.lit("934e554d50590100"), size, F.hex(head.cast("binary")), "body")
        return F.struct(F.concat("g", F.lit(name)).alias("name"), F.unhex(F.when(F.expr("g % 11 = 5"), F.substring(whole, 1, 60)).otherwise(whole)).alias("content"))

    both = F.array(stored("_acoustic.npy", F.col("n").cast("string")), F.when(F.expr("g % 3 <> 0"), stored("_visual.npy", F.col("arrays").cast("string"))))
    folder = work_folder(t.spark, "arrays")
    sink.write_blobs(samples(t).select(F.explode(F.array_compact(both)).alias("f")).select("f.*"), folder)
    return folder


def array_lengths(t):
    files = src.numbered_files(t.spark, array_folder(t))
    return hd.array_participants(files, hd.media_headers(files))


add("SRC14_array_headers", array_lengths,
    "SELECT p AS participant_id, CASE WHEN g % 11 <> 5 THEN CAST(n AS DOUBLE) END AS audio_length, CASE WHEN g % 3 <> 0 AND g % 11 <> 5 THEN CAST(arrays AS DOUBLE) END AS visual_length, CASE WHEN g % 3 = 0 THEN 'visual' ELSE '' END AS missing_files, "
    "CASE WHEN g % 11 <> 5 THEN '' WHEN g % 3 = 0 THEN 'unreadable:file ends inside its header' ELSE 'unreadable:file ends inside its header,unreadable:file ends inside its header' END AS errors "
    f"FROM {GROUPS}")


def blank_transcripts(t):
    folder = work_folder(t.spark, "scripts")
    made = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("_TRANSCRIPT.csv")).alias("name"), F.expr("IF(doc_id % 9 = 0, ' \t\n  ', text)").cast("binary").alias("content"))
    sink.write_blobs(made.filter("name IS NOT NULL"), folder)
    owners = src.listing(t.spark, folder).select("file_path", F.regexp_extract("name", "^[0-9]+", 0).alias("participant_id"))
    return hd.file_issues(hd.transcript_errors(owners), owners)


add("DQ20_empty_transcripts", blank_transcripts,
    "SELECT 'file' AS gate, 'transcript_validation' AS check, 'warning' AS severity, doc_id || '_TRANSCRIPT.csv: empty_transcript' AS message, CAST(doc_id AS VARCHAR) AS participant_id FROM documents "
    r"WHERE doc_id % 9 = 0 OR text IS NULL OR NOT regexp_matches(text, '\S')")

add("SRC7_numbered_discovery", lambda t: reg.discover(t.spark, "dvlog", numbered_tree(t)).select(*SAMPLE), numbered_sql())
add("UDF2_adapter_by_name", lambda t: reg.discover_all(t.spark, {"daic_woz": interview_tree(t), "dvlog": numbered_tree(t)}).select(*SAMPLE), f"{INTERVIEWED} UNION ALL {numbered_sql()}", "dataset_index")
