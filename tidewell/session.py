"""Session set-up shared by tests, the bench and command-line use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidewell", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for one run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it has ended, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors.

    A written table keeps columns compressed and gives the next round its size, which an RDD
    checkpoint does not. The shuffle files it came from are freed.
    """
    spark = df.sparkSession
    path = work_folder(spark, "round")
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written = path
    return table


def dealt(df: DataFrame, *keys: str, moved: bool = False, parts: int = 1) -> DataFrame:
    """A table written in the shared folder, in buckets by ``keys``: joins by the keys read it as it is dealt.

    Rows of one key are one bucket's, so the key should not be one that a large part of the rows share.
    ``moved``: ``df`` has been repartitioned by the keys. ``parts``: so many jobs write it, each the rows of some keys, and
    the shuffle files of one are freed before the next.
    """
    spark = df.sparkSession
    name, buckets, path = f"dealt_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), work_folder(spark, "dealt")
    for part in range(parts):
        rows = df.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == part) if parts > 1 else df
        rows = rows if moved else rows.repartition(buckets, *keys)
        with shuffles_freed(spark):
            rows.write.bucketBy(buckets, *keys).format("parquet").option("compression", "zstd").option("path", path).mode("append").saveAsTable(name)
    table = spark.table(name)
    table.written = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``reliable_checkpoint`` or ``dealt`` has written, once nothing reads them any more."""
    for table in tables:
        for written in [table.written] if isinstance(table.written, str) else table.written:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
