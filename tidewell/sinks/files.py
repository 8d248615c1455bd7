"""File sinks. All of them are plain distributed writes; nothing is gathered first."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.graph import graphml_lines
from tidewell.session import reliable_checkpoint
from tidewell.sources.headers import located


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({n: F.to_json(n) for n in nested}) if nested else df


def write_formats(df: DataFrame, folder: str, name: str, formats=("csv", "json", "parquet"), partition_by: tuple[str, ...] = ()) -> dict[str, str]:
    """The same table in several formats (SNK1, SNK4, SNK6, SNK15)."""
    paths = {}
    for kind in formats:
        path = f"{folder}/{name}.{kind}"
        writer = (_flat(df) if kind == "csv" else df).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if kind == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(kind).save(path)
        paths[kind] = path
    return paths


def export_index(index: DataFrame, folder: str) -> dict[str, str]:
    return write_formats(index, folder, "dataset_index")


def export_samples(index: DataFrame, folder: str) -> dict[str, str]:
    """The seven sample columns (SNK4)."""
    cols = ("sample_id", "participant_id", "dataset", "modality", "label", "split", "file_path")
    return write_formats(index.select(*cols), folder, "samples")


def write_metadata(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """The metadata tables as CSV, that of the files with a folder for each modality (SNK5)."""
    return {name: write_formats(df, folder, name, ("csv",), ("modality",) if name == "files" else ())["csv"] for name, df in tables.items()}


def save_sessions(sessions: DataFrame, folder: str) -> str:
    """``sessions.parquet`` (SNK2)."""
    return write_formats(sessions, folder, "sessions", ("parquet",))["parquet"]


def config_hash(config: dict) -> str:
    """First 16 hex digits over the canonical JSON of a configuration (AGG29)."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def reproducibility_row(spark: SparkSession, config: dict, content_hash: str = "") -> DataFrame:
    """One row that is written next to every output (AGG29)."""
    rows = [(config_hash(config), content_hash, spark.version, json.dumps(config, sort_keys=True))]
    return spark.createDataFrame(rows, "config_hash STRING, content_hash STRING, spark_version STRING, config STRING")


def export_training(sessions: DataFrame, folder: str, config: dict) -> dict[str, str]:
    """Training manifest partitioned by split, plus the reproducibility row (SNK3)."""
    paths = {"parquet": f"{folder}/training_manifest.parquet", "csv": f"{folder}/training_manifest.csv", "reproducibility": f"{folder}/reproducibility.json"}
    sessions.write.mode("overwrite").partitionBy("split").parquet(paths["parquet"])
    _flat(sessions).write.mode("overwrite").option("header", True).csv(paths["csv"])
    reproducibility_row(sessions.sparkSession, config).write.mode("overwrite").json(paths["reproducibility"])
    return paths


def append_audit(entries: DataFrame, path: str) -> None:
    """Append-only audit rows (SNK10)."""
    entries.write.mode("append").json(path)


AUDIT_DDL = ("operation STRING, request_id STRING, transaction_id STRING, entity_type STRING, entity_id STRING, affected_nodes BIGINT, "
             "affected_relationships BIGINT, execution_time_ms DOUBLE, rollback BOOLEAN, created_at TIMESTAMP")


def recent_audit(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The newest entries; equal times are ordered by their ids."""
    return spark.read.schema(AUDIT_DDL).json(path).orderBy(F.desc("created_at"), "transaction_id", "request_id", "entity_id").limit(n)


def write_gate_report(gates: DataFrame, path: str) -> None:
    """Gate rows with the approval flag (SNK11)."""
    failed = gates.agg((F.count_if(F.col("status") == "failed") == 0).alias("approved"))
    gates.crossJoin(failed).write.mode("overwrite").json(path)


def export_transcripts(utterances: DataFrame, folder: str) -> str:
    """Ordered utterances with relative time, one folder per participant (SNK13)."""
    path = f"{folder}/transcripts.json"
    rows = utterances.withColumn("relative_time", F.col("start_time"))
    # long transcripts are cut into parts, so that no participant fills one task; small files cost by their number, so the count of tasks is fixed
    tasks = int(utterances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "participant_id", F.floor(F.col("ord") / 100_000)).sortWithinPartitions("participant_id", "ord").write.mode("overwrite").partitionBy("participant_id").json(path)
    return path


def write_vectors(vectors: DataFrame, path: str, version: str = "v1.0") -> None:
    """Vector store: vector, dimension, checksum and version by feature type (SNK14)."""
    rows = vectors.select(
        "participant_id", "session_id", "feature_type", "v", F.size("v").alias("embedding_dim"),
        F.sha2(F.to_json(F.struct("v")), 256).alias("checksum"), F.lit(version).alias("feature_version"),
    )
    rows.write.mode("append").partitionBy("feature_type").parquet(path)


def read_vectors(spark: SparkSession, path: str, feature_type: str, participant: str | None = None) -> DataFrame:
    """Vectors of one type; the partition filter prunes the scan."""
    rows = spark.read.parquet(path).filter(F.col("feature_type") == feature_type)
    return rows if participant is None else rows.filter(F.col("participant_id") == participant)


def new_only(rows: DataFrame, spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose keys are not stored yet, so a re-run writes nothing twice."""
    from tidewell.sources.files import path_exists

    if not path_exists(spark, path):
        return rows
    return rows.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")


def write_graph(node: DataFrame, edge: DataFrame, folder: str) -> dict[str, str]:
    """Node and edge tables as JSON, CSV and GraphML body lines (SNK7)."""
    paths = {}
    for name, df in (("nodes", node), ("edges", edge)):
        for kind, path in write_formats(df, folder, name, ("csv", "json")).items():
            paths[f"{name}_{kind}"] = path
    paths["graphml"] = f"{folder}/graphml"
    lines = graphml_lines(node, edge)
    spark = node.sparkSession
    ends = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part INT, line STRING")
    # range-partitioned, so the header file sorts first and the footer last
    lines.unionByName(ends).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(paths["graphml"])
    return paths


def outputs_present(spark: SparkSession, paths: dict[str, str], processed: DataFrame | None = None, participants: DataFrame | None = None) -> DataFrame:
    """Which outputs exist, and the feature coverage (DQ8, DQ17)."""
    from tidewell.sources.files import path_exists

    rows = spark.createDataFrame([(k, path_exists(spark, p)) for k, p in paths.items()], "check STRING, passed BOOLEAN")
    if processed is not None and participants is not None:
        done = processed.agg(F.count("*").alias("n")).crossJoin(participants.select("participant_id").distinct().agg(F.count("*").alias("p")))
        rows = rows.unionByName(done.select(F.lit("feature_coverage").alias("check"), (F.col("n") >= F.least("p", F.lit(1))).alias("passed")))
    return rows


def write_blobs(df: DataFrame, folder: str) -> DataFrame:
    """One file per row of ``name, content`` (binary), written by the tasks; returns ``file_path, size``.

    A file is written under a name of its attempt and then moved, so a repeated task replaces its own files. Names are taken to
    be distinct; a null content gives an empty file.
    """
    from tidewell.sources.files import qualified

    folder = qualified(df.sparkSession, folder)

    def write(batches):
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, data = f"{folder}/{name}", content or b""
                system, local = located(path)
                above, _, last = local.rpartition("/")
                system.create_dir(above, recursive=True)
                attempt = f"{above}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write(data)
                system.move(attempt, local)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"file_path": pa.array(paths, pa.string()), "size": pa.array(sizes, pa.int64())})

    return reliable_checkpoint(df.select("name", "content").mapInArrow(write, "file_path STRING, size LONG"))
