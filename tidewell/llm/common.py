"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.session import reliable_checkpoint, work_folder

__all__ = ["documents", "table", "reliable_checkpoint", "work_folder", "texts_of", "text_bytes", "slices", "SMALL_SLICE", "mix", "crc_mod", "id_text", "row_numbers", "sorted_positions"]

SLICE_BYTES = 4 << 20
#: Bytes of text hashed or parsed at a time where that holds many times as much.
SMALL_SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """The columns the operators work on, with the row's key as ``_key`` if one is named; any further column, whatever its name, is left behind."""
    key = [F.col(f"`{key_col}`").alias("_key")] if key_col else []
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *key)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the n+1 offsets of its rows; null is empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8).copy()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(bounds[0])
    return raw[first : int(bounds[-1])], bounds - first


def texts_of(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def row_numbers(rows: DataFrame, group: str) -> DataFrame:
    """A written table with dense ``pos`` from 0 within each ``group``, in the table's order, and the group's ``size``.

    ``rows`` must be written with ``_at``, from ``monotonically_increasing_id``. Only one row per
    group and written partition is gathered to add up the partitions before.
    """
    part = F.shiftright("_at", 33).alias("_part")
    spans = rows.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    order = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(order.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = reliable_checkpoint(spans.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(order).alias("size")))
    return rows.withColumn("_part", F.shiftright("_at", 33)).join(spans, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def sorted_positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in the order of their ``group`` and its ``size``.

    Dealt by sampled ranges of group and order, so that a large group is many partitions.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    return row_numbers(reliable_checkpoint(placed.withColumn("_at", F.monotonically_increasing_id())), group)
