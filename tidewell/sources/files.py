"""File sources: index CSVs, labels, transcripts, directory listings, lexicons, run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions.numeric import rounded
from tidewell.functions.quality import alignment, label_class, parser_quality
from tidewell.operators.dataset import session_index
from tidewell.schemas import AUDIO_ENDINGS, FACIAL_MARKS, TEXT_ENDINGS, VIDEO_ENDINGS
from tidewell.session import reliable_checkpoint
from tidewell.sources.headers import children, media_headers

INDEX_DDL = (
    "participant_id STRING, session_id STRING, dataset STRING, modality STRING, file_path STRING, label STRING, split STRING, "
    "language STRING, audio_length DOUBLE, transcript_length INT, quality_score DOUBLE, sync_score DOUBLE"
)
BOM = "﻿"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as the session resolves it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def dataset_index(spark: SparkSession, path: str) -> DataFrame:
    """Flat index CSV with a header (SRC1)."""
    return spark.read.schema(INDEX_DDL).option("header", True).option("enforceSchema", False).csv(path)


def file_name(column: str | Column = "_metadata.file_name") -> Column:
    return F.lower(F.col(column) if isinstance(column, str) else column)


def first_column(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-empty of several possible columns, BOM and case kept apart."""
    found = {c.replace(BOM, ""): c for c in df.columns}
    present = [F.col(f"`{found[n]}`").cast("string") for n in names if n in found]
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in present]) if present else F.lit(None).cast("string")


def participant_name(raw: Column) -> Column:
    return F.trim(F.replace(raw, F.lit("_P"), F.lit("")))


def split_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Official label files: id, label, gender and the split read from the file name (SRC2).

    Headers differ between files, so every file is read as lines and its own header names the fields.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).select(
        "value", file_name().alias("source_file"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    lines = lines.filter(F.col("source_file").rlike("train|dev|test|split")).withColumn("value", F.replace("value", F.lit(BOM), F.lit("")))
    return _by_header(lines, ("Participant_ID", "participant_ID", "participant_id", "participant", "id"), {
        "raw_label": ("PHQ8_Binary", "label", "depression"), "gender": ("Gender", "gender"),
    }).select(
        participant_name(F.col("key")).alias("participant_id"),
        F.when(F.col("source_file").rlike("dev|validation"), "dev").when(F.col("source_file").contains("test"), "test").otherwise("train").alias("split"),
        F.when(F.col("raw_label").isNull(), "unknown").otherwise(label_class(F.col("raw_label"))).alias("label"),
        "gender", "source_file",
    )


def _by_header(lines: DataFrame, keys: tuple[str, ...], fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Comma lines of many small files joined with the header line of their own file."""
    is_header = F.expr("exists(split(value, ','), w -> array_contains(array({}), trim(w)))".format(", ".join(f"'{k}'" for k in keys)))
    headers = lines.filter(is_header).groupBy("file").agg(F.min("value").alias("_h")).select("file", F.transform(F.split("_h", ","), F.trim).alias("_h"))
    rows = lines.filter(~is_header & (F.trim("value") != "")).join(headers, "file").withColumn("_v", F.split("value", ","))

    def pick(names: tuple[str, ...]) -> Column:
        cells = [F.trim(F.get("_v", (F.array_position("_h", n) - 1).cast("int"))) for n in names]
        return F.coalesce(*[F.when(F.array_contains("_h", n) & (c != ""), c) for n, c in zip(names, cells)])

    return rows.select("source_file", pick(keys).alias("key"), *[pick(v).alias(k) for k, v in fields.items()]).filter("key IS NOT NULL")


def numbered_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV of the numeric layout: aliases, fold mapping, float duration (SRC3)."""
    df = spark.read.option("header", True).csv(path)
    fold = F.lower(first_column(df, ("fold", "split")))
    raw = first_column(df, ("label", "depression"))
    return df.select(
        first_column(df, ("index", "participant", "id", "video_id")).alias("participant_id"),
        F.when(raw.isNull(), "unknown").otherwise(label_class(raw)).alias("label"),
        F.when(fold.isin("valid", "validation"), "dev").otherwise(fold).alias("split"),
        first_column(df, ("duration",)).try_cast("double").alias("duration"),
        first_column(df, ("gender",)).alias("gender"),
    ).filter("participant_id IS NOT NULL")


#: Columns of a delimited transcript that are read.
MOST_COLUMNS = 32


def delimited_records(spark: SparkSession, folder: str, pattern: str, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """Records of many delimited files with their own headers: ``file, ord, head, cells``.

    Spark's CSV parser reads a file as a stream, so quoted delimiters, doubled quotes and quoted line breaks
    stay inside their cell. A file whose first record has two cells by tabs is read by tabs, any other by
    commas, which are tried if there is one. Blank lines are no records; ``ord`` counts from 0 after the header.
    """

    def parsed(tabs: bool) -> DataFrame:
        ddl = ", ".join(f"c{k} STRING" for k in range(most_columns))
        options = {"sep": "\t" if tabs else ",", "quote": '"', "escape": '"', "multiLine": True, "header": False, "emptyValue": "", "pathGlobFilter": pattern}
        rows = spark.read.schema(ddl).options(**options).csv(folder).select(F.col("_metadata.file_path").alias("file"), F.array(*[f"c{k}" for k in range(most_columns)]).alias("cells"))
        # a file is read by one task, so its records have consecutive numbers; written, as they are read more than once, by
        # a fixed count of tasks, as Spark deals 32 small files to one
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return reliable_checkpoint(rows.coalesce(tasks).withColumn("_at", F.monotonically_increasing_id()))

    by_tab = parsed(True)

    def heads(rows: DataFrame) -> DataFrame:
        return rows.groupBy("file").agg(F.min(F.struct("_at", "cells")).alias("_h")).select("file", F.col("_h._at").alias("_first"), F.transform("_h.cells", lambda c: F.trim(F.replace(c, F.lit(BOM), F.lit("")))).alias("head"))

    two = F.get("head", F.lit(1)).isNotNull()
    tabbed = heads(by_tab).filter(two)
    rows = by_tab.join(tabbed, "file")
    if not heads(by_tab).filter(~two).isEmpty():
        by_comma = parsed(False)
        rows = rows.unionByName(by_comma.join(heads(by_comma).join(tabbed, "file", "left_anti"), "file"))
    return rows.filter("_at > _first").select("file", (F.col("_at") - F.col("_first") - 1).cast("int").alias("ord"), "head", "cells")


def transcripts(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Delimited transcripts to ordered utterances; the first line decides the delimiter (SRC4, TXT9).

    Cells may be quoted. White space in a text, a quoted line break too, becomes one blank.
    """
    rows = delimited_records(spark, folder, pattern)

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.when(F.array_contains("head", n), F.nullif(F.get("cells", (F.array_position("head", n) - 1).cast("int")), F.lit(""))) for n in names])

    start = F.coalesce(pick("start_time", "Start_Time").try_cast("double"), F.lit(0.0))
    stop = F.coalesce(pick("stop_time", "Stop_Time").try_cast("double"), start)
    return rows.select(
        "file", F.coalesce(pick("speaker", "Speaker"), F.lit("unknown")).alias("speaker"), start.alias("start_time"), stop.alias("stop_time"),
        tx.clean(F.coalesce(pick("value", "Text", "text"), F.lit("")), cap_repeats=False).alias("text"), "ord",
        rounded(stop - start, 3).alias("duration"),
    )


def plain_transcripts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """A text file as one utterance of an unknown speaker (SRC5)."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file"), F.lit("unknown").alias("speaker"), tx.clean(F.col("value"), cap_repeats=False).alias("text"), F.lit(0).alias("ord"))


def classify(name: Column) -> Column:
    """File kind from its name: facial marks first, then endings (SRC6)."""
    low = F.lower(name)
    ext = F.regexp_extract(low, r"(\.[^.]+)$", 1)
    return (
        F.when(low.rlike("|".join(FACIAL_MARKS)), "facial_features")
        .when(ext.isin(*AUDIO_ENDINGS), "audio")
        .when(ext.isin(*VIDEO_ENDINGS), "video")
        .when(ext.isin(*TEXT_ENDINGS) & low.contains("transcript"), "transcript")
        .when((ext == ".csv") & low.rlike("covarep|formant"), "audio_features")
        .when(ext == ".csv", "transcript")
        .when(ext.isin(*TEXT_ENDINGS), "text")
        .otherwise("other")
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing with size and kind, empty files included; contents are not read (SRC6).

    Folders are listed by tasks, level by level, so the tree does not pass through the driver. One folder is listed by one task.
    Spark's own file sources leave out files of no bytes, which the integrity rules ask for.
    """
    level = spark.createDataFrame([(qualified(spark, folder),)], "path STRING")
    found = []
    while True:
        rows = reliable_checkpoint(level.repartition("path").mapInArrow(children, "path STRING, name STRING, size LONG, folder BOOLEAN"))
        found.append(rows.filter("NOT folder"))
        level = rows.filter("folder").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionByName, found)
    return files.select(F.col("path").alias("file_path"), "name", "size", classify(F.col("name")).alias("modality"))


def interview_files(spark: SparkSession, folder: str, labels: DataFrame | None = None) -> DataFrame:
    """Folders ``<id>_P`` (or ``key=<id>_P``) to sample rows with label and split attached (SRC7)."""
    files = listing(spark, folder).withColumn("participant_id", F.regexp_extract("file_path", r"/(?:[^/=]+=)?([^/=]+)_P/", 1)).filter("participant_id <> ''")
    ext = F.regexp_extract(F.lower("name"), r"(\.[^.]+)$", 1)
    deep = F.col("file_path").rlike("[/=]participant_data/")
    own = F.col("name") == F.concat("participant_id", F.lit("_AUDIO.wav"))
    script = F.col("name") == F.concat("participant_id", F.lit("_TRANSCRIPT.csv"))
    video = ext.isin(".mp4", ".avi")
    kind = (
        F.when(deep & (ext == ".wav"), "audio").when(deep & ext.isin(".txt", ".transcript"), "text").when(~deep & own, "audio").when(~deep & script, "text").when(video, "video")
    )
    rows = files.withColumn("modality", kind).filter("modality IS NOT NULL")
    return _attach(rows, labels, "daic_woz").withColumn(
        "sample_id", F.concat_ws("_", "participant_id", "modality", F.regexp_replace("name", r"\.[^.]+$", ""))
    )


def numbered_files(spark: SparkSession, folder: str, labels: DataFrame | None = None) -> DataFrame:
    """Numeric folders or suffixed array files to sample rows (SRC7, SRC14)."""
    files = listing(spark, folder).filter(F.lower("name").endswith(".npy"))
    parent = F.element_at(F.split("file_path", "/"), -2)
    stem = F.regexp_replace("name", r"\.npy$", "")
    pid = F.when(parent.rlike("^[0-9]+$"), parent).otherwise(F.regexp_replace(stem, "^(acoustic|visual)_|_(acoustic|visual)$", ""))
    rows = files.withColumn("participant_id", pid).withColumn("modality", F.when(F.lower("name").contains("acoustic"), "audio").otherwise("visual"))
    return _attach(rows, labels, "dvlog").withColumn("sample_id", F.concat_ws("_", "participant_id", "modality"))


def labelled_interviews(spark: SparkSession, folder: str) -> DataFrame:
    """The interview layout with its official ``splits/*.csv``, where there are any, attached (SRC7)."""
    where = f"{folder}/splits"
    return interview_files(spark, folder, split_labels(spark, where) if path_exists(spark, where) else None)


def labelled_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The numeric layout with its ``labels.csv``, where there is one, attached (SRC7)."""
    where = f"{folder}/labels.csv"
    return numbered_files(spark, folder, numbered_labels(spark, where) if path_exists(spark, where) else None)


def _attach(rows: DataFrame, labels: DataFrame | None, dataset: str) -> DataFrame:
    rows = rows.withColumns({"session_id": F.col("participant_id"), "dataset": F.lit(dataset), "language": F.lit("en")})
    if labels is None:
        return rows.withColumns({"label": F.lit("unknown"), "split": F.lit(None).cast("string")})
    # label and split come from one row: the first by label, then split
    one = labels.groupBy("participant_id").agg(F.min(F.struct("label", "split")).alias("_one")).select("participant_id", "_one.label", "_one.split")
    return rows.join(one, "participant_id", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def participants(files: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per participant with modality lengths, sync and quality (SRC13, SRC14).

    ``files`` has ``participant_id, modality, file_path``; ``lengths`` has ``participant_id,
    audio_length, video_length, transcript_length, last_stop, transcript_quality``.
    """
    has = files.groupBy("participant_id").agg(
        *[F.max(F.col("modality") == m).alias(f"has_{m}") for m in ("audio", "video", "transcript")],
        F.count("*").alias("files"),
    )
    rows = has.join(lengths, "participant_id", "left")
    sync = alignment(F.array("audio_length", "video_length", "last_stop"))
    q = parser_quality(F.col("audio_length"), F.col("video_length"), F.col("transcript_length"), F.col("transcript_quality"), sync["score"],
                       F.col("has_audio"), F.col("has_video"), F.col("has_transcript"))
    missing = F.array_compact(F.array(*[F.when(~F.col(f"has_{m}"), m) for m in ("audio", "video", "transcript")]))
    return rows.select("*", sync["offset"].alias("sync_offset"), sync["score"].alias("sync_score"), q["overall"].alias("quality_score"), F.array_join(missing, ",").alias("missing_files"))


def run_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON file of metrics per run (SRC9)."""
    df = spark.read.option("multiLine", True).json(pattern)
    return df.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def sessions_or_index(spark: SparkSession, session_path: str, index_path: str) -> DataFrame:
    """The stored session table, else rebuilt from the flat index (SRC10)."""
    if path_exists(spark, session_path):
        return spark.read.parquet(session_path)
    return session_index(dataset_index(spark, index_path))


def lexicons(spark: SparkSession, folder: str, defaults: DataFrame | None = None) -> DataFrame:
    """``(category, term)`` rows from one text file per category; files replace the defaults (SRC11)."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("category"), "value")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select("category", F.lower(F.trim("value")).alias("term"))
    if defaults is None:
        return rows
    return rows.unionByName(defaults.join(rows.select("category").distinct(), "category", "left_anti"))


def version_record(files: DataFrame, name: str) -> DataFrame:
    """Hash over the (path, size) entries of all files, whatever their order (AGG28).

    Each entry's sha256 is cut into four numbers; their sums over all files are hashed. Sums are
    partial aggregates, so the listing is neither sorted nor gathered.
    """
    entry = F.sha2(F.concat("file_path", F.lit("|"), F.col("size").cast("string")), 256)
    parts = [F.sum(F.conv(F.substring(entry, 1 + 13 * k, 13), 16, 10).cast("decimal(38,0)")).alias(f"_s{k}") for k in range(4)]
    sums = files.agg(F.count("*").alias("_n"), *parts)
    text = F.concat_ws(":", F.col("_n").cast("string"), *[F.coalesce(F.col(f"_s{k}"), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4)])
    return sums.select(F.sha2(text, 256).alias("dataset_hash"), F.lit(name).alias("dataset_source"), F.lit("pending").alias("validation_status"))


def wav_header(spark: SparkSession, folder: str) -> DataFrame:
    """Channel count, rate and duration of PCM files, by ranged reads (DQ20)."""
    files = listing(spark, folder).filter(F.lower("name").endswith(".wav")).select("file_path", "size")
    fields = media_headers(files).select("file_path", "channels", "sample_rate", "bit_depth", F.col("seconds").alias("duration_seconds"), "error")
    return files.join(fields, "file_path")
