"""Substring deduplication by level-wise doubling over word windows.

Lengths double from about a quarter of the window to the window: 9, 18 and 35 words for the default.
At the first length, each window is represented by the 9-word string in it that its content selects
(``anchors``). Strings that occur once drop out; repeated ones alone are extended to twice the length,
to the right and to the left. Of the windows of full length, those are hashed and counted for which the
extensions they hold are repeated. Words covered by a repeated window are removed.

Where all occurrences of an anchor lie in equal spans, the extensions of all lengths are repeated with
them, and the windows need no further count.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.anchors import ROW, distinct_spans, places_by_row, ranges_by_row, repeated, row_key, spans_of
from tidewell.llm.common import id_text, reliable_checkpoint, slices, text_bytes
from tidewell.llm.tokens import Windows, words

WINDOW = 35
#: Bytes of text hashed at a time; the hashing holds some forty times as much.
SLICE = 1 << 20

INSIDE = np.ones(256, bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def _levels(width: int) -> tuple[int, int]:
    half = -(-width // 2)
    return -(-half // 2), half


def _anchor_rows(width: int):
    part, _ = _levels(width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, bounds = text_bytes(batch.column(1))
            _, _, hashes, rows = words(data, bounds, INSIDE)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            s = spans_of(hashes, cuts, width, part)
            base = cuts[s.row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.anchor.view(np.int64)), pa.array(s.span.view(np.int64)), batch.column(0).take(pa.array(s.row)), *(pa.array((x - base).astype(np.int32)) for x in (s.low, s.high, s.at))],
                ["a", "s", "key", "lo", "hi", "at"],
            )

    return run


def _extensions(width: int):
    """Per span: hashes of the strings of half the window right and left of the anchor, and of its windows."""
    part, half = _levels(width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, bounds = text_bytes(batch.column(0))
            _, _, hashes, rows = words(data, bounds, INSIDE)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            windows = Windows(hashes)
            places = batch.column(1)
            flat = places.flatten()
            a, s, n, lo, hi, at = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            base = cuts[np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))]
            lo, hi, at = lo + base, hi + base, at + base
            # a window that starts at i holds the right extension if i + width >= at + half, the left one if i <= at - part
            right_in, left_in = hi + width >= at + half, lo <= at - (half - part)
            right = windows.hash(at, np.where(right_in, at + half, at)).view(np.int64)
            left = windows.hash(np.where(left_in, at - (half - part), at), np.where(left_in, at + part, at)).view(np.int64)
            count = hi - lo + 1
            start = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            full = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(windows.hash(start, start + width).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (a, s, n)] + [pa.array(right), pa.array(right_in), pa.array(left), pa.array(left_in), pa.array((at - lo).astype(np.int32)), full],
                ["a", "s", "n", "r", "r_in", "l", "l_in", "shift", "windows"],
            )

    return run


EXTENDED = "a long, s long, n long, r long, r_in boolean, l long, l_in boolean, shift int, windows array<long>"


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``key, lo, hi``: ranges of starts of repeated windows, for ``docs`` with columns ``key`` and ``text``."""
    part, half = _levels(width)
    hits = reliable_checkpoint(repeated(reliable_checkpoint(docs.select("key", "text").mapInArrow(_anchor_rows(width), ROW))))
    whole = hits.filter("lone").select("key", "lo", "hi")

    spans = distinct_spans(hits)
    extended = reliable_checkpoint(docs.join(places_by_row(spans), "key").select("text", "places").mapInArrow(_extensions(width), EXTENDED).dropDuplicates(["a", "s"]))
    ends = extended.filter("r_in").select(F.lit(1).alias("side"), "a", F.col("r").alias("h"), "n").union(extended.filter("l_in").select(F.lit(0).alias("side"), "a", F.col("l").alias("h"), "n"))
    again = reliable_checkpoint(ends.groupBy("side", "a", "h").agg(F.sum("n").alias("c")).filter("c > 1").select("side", "a", "h"))
    right, left = (again.filter(F.col("side") == k).select("a", F.col("h").alias(c), F.lit(True).alias(c + "_again")) for k, c in ((1, "r"), (0, "l")))
    grown = extended.join(right, ["a", "r"], "left").join(left, ["a", "l"], "left").filter("r_again OR l_again")
    offset = F.col("shift") - F.col("j")  # words of the window before the anchor
    windows = grown.select("a", "s", "n", "shift", "r_again", "l_again", F.posexplode("windows").alias("j", "w"))
    alive = ((offset > width - half) | F.col("r_again").isNotNull()) & ((offset < half - part) | F.col("l_again").isNotNull())
    windows = reliable_checkpoint(windows.filter(alive).select("a", "s", "n", "j", "w"))
    counts = reliable_checkpoint(windows.groupBy("w").agg(F.sum("n").alias("c")).filter("c > 1").select("w"))
    found = reliable_checkpoint(windows.join(counts, "w").groupBy("a", "s").agg(F.collect_list("j").alias("starts")))  # at most width - part + 1
    partial = hits.filter(~F.col("lone")).join(found, ["a", "s"]).select("key", "lo", F.explode("starts").alias("j"))
    return whole.union(partial.select("key", (F.col("lo") + F.col("j")).alias("lo"), (F.col("lo") + F.col("j")).alias("hi")))


def covered(cuts: np.ndarray, ranges: pa.Array, width: int) -> np.ndarray:
    """Symbols of a slice that windows cover; row k has symbols cuts[k]:cuts[k + 1], ``ranges`` its window starts.

    Works on the flat Arrow values: a row may have a range for each of its symbols.
    """
    flat = ranges.flatten()
    base = np.repeat(cuts[:-1], ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    n = int(cuts[-1])
    step = np.bincount(base + flat.field(0).to_numpy(zero_copy_only=False), minlength=n + 1)
    step = step - np.bincount(base + flat.field(1).to_numpy(zero_copy_only=False) + width, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def substring_dedup(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked, ``kept_text``.

    A window is ``width`` words of one row; a word goes if a window over it also starts anywhere else.
    Words are split at blanks and kept as they are. Null and empty texts have no words; texts shorter
    than a window stay whole. A repeated row is one more document, so all its windows are repeated.
    Null ids are allowed; other columns are ignored; an empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col).withColumn("key", row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    ranges = ranges_by_row(repeated_windows(rows, width))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    made = 4 if with_text else 3

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            out: list[tuple[int, int, str, str]] = []
            split = [text.encode().split() for text in batch.column(1).fill_null("").to_pylist()]
            cuts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))
            kept_words = ~covered(cuts, batch.column(2), width)
            for k, parts in enumerate(split):
                keep = kept_words[cuts[k] : cuts[k + 1]]
                removed = len(parts) - int(keep.sum())
                kept = b" ".join(itertools.compress(parts, keep.tolist()) if removed else parts)
                out.append((len(parts), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else ""))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns[:made], kinds))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: made + 1],
            )

    schema = T.StructType([rows.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return rows.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema.add("kept_text", "string") if with_text else schema)
