"""Removal of long byte strings that occur more than once, by suffix sorting with a difference cover.

Equal strings choose equal anchors (``anchors``), so the corpus is dealt by anchor: all strings that
could be equal meet, whatever documents they come from, and no longer text than the spans around
repeated anchors has to be sorted. Equal spans are counted and kept once. The distinct spans of an
anchor are sorted as one text by the difference-cover algorithm (``suffixes``) and neighbours in suffix
order are compared on ``width`` bytes. Where an anchor has one span only, its count decides.

An anchor inside very many different spans (a frequent line) would make one sort too large. Its windows
are then divided by the place of the anchor in them, into halves that share a longer common string, and
dealt anew by that string; this ends at the latest when the common string is the window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.anchors import ROW, distinct_spans, places_by_row, ranges_by_row, repeated, row_key, spans_of
from tidewell.llm.common import id_text, reliable_checkpoint, slices, text_bytes
from tidewell.llm.passages import covered
from tidewell.llm.suffixes import repeated_starts
from tidewell.llm.tokens import BYTE_CODE

WIDTH = 400
#: Distinct spans of an anchor that are sorted in one task; an anchor with more is divided.
MOST_SPANS = 1000
#: Bytes of spans in a task's sort, on average.
SORT_BYTES = 2 << 20
SLICE = 1 << 20

SPAN = "g long, s long, n long, x int, y int, ref int, m int, bytes binary"
FOUND = "g long, s long, j0 int, j1 int"


def _part(width: int) -> int:
    return -(-width // 4)


def _anchor_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, cuts = text_bytes(batch.column(1))
            s = spans_of(BYTE_CODE[data], cuts, width, _part(width))
            base = cuts[s.row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.anchor.view(np.int64)), pa.array(s.span.view(np.int64)), batch.column(0).take(pa.array(s.row)), *(pa.array((x - base).astype(np.int32)) for x in (s.low, s.high, s.at))],
                ["a", "s", "key", "lo", "hi", "at"],
            )

    return run


def _span_bytes(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            rows = []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for p in places:
                    rows.append((p["a"], p["s"], p["n"], 0, width - _part(width) + 1, p["at"] - p["lo"], p["hi"] - p["lo"] + 1, raw[p["lo"] : p["hi"] + width]))
            yield _batch(rows, SPAN)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _divide(width: int):
    """Both halves of each span's windows, by the anchor's place; ``parent`` and ``base`` say where they come from."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                middle = (r["x"] + r["y"] + 1) // 2
                for x, y in ((r["x"], middle), (middle, r["y"])):
                    first, last = max(r["ref"] - y + 1, 0), min(r["ref"] - x, r["m"] - 1)
                    if first > last:
                        continue
                    common = r["bytes"][r["ref"] - x : r["ref"] - y + 1 + width]
                    piece = r["bytes"][first : last + width]
                    group = xxhash.xxh3_64_intdigest(common, r["g"] & 0xFFFF ^ x) - (1 << 63)
                    rows.append((r["g"], r["s"], first, group, xxhash.xxh3_64_intdigest(piece, 7) - (1 << 63), r["n"], x, y, r["ref"] - first, last - first + 1, piece))
            yield _batch(rows, "pg long, ps long, base int, " + SPAN)

    return run


def _sorted_bucket(width: int):
    def run(rows: pa.Table) -> pa.Table:
        g, s, n, m = (rows.column(c).to_numpy() for c in ("g", "s", "n", "m"))
        strings = [np.frombuffer(b, np.uint8) for b in rows.column("bytes").to_pylist()]
        string, start = repeated_starts(strings, width)
        some = n[string] == 1
        string, start = string[some], start[some]
        new = np.ones(len(string), bool)
        new[1:] = (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(string)) - 1 if len(first) else first
        often = np.flatnonzero(n > 1)  # the whole span occurs again
        which = np.concatenate((string[first], often))
        return pa.table({"g": g[which], "s": s[which], "j0": pa.array(np.concatenate((start[first], np.zeros(len(often), np.int64))).astype(np.int32)), "j1": pa.array(np.concatenate((start[last], m[often] - 1)).astype(np.int32))})

    return run


def repeated_in_spans(spans: DataFrame, width: int = WIDTH, most: int = MOST_SPANS) -> DataFrame:
    """``g, s, j0, j1``: repeated window starts of each span, among the spans of its group."""
    groups = spans.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("c")).filter("c > 1")
    sized = reliable_checkpoint(spans.join(reliable_checkpoint(groups), "g"))
    alone = sized.filter("k = 1").select("g", "s", F.lit(0).alias("j0"), (F.col("m") - 1).alias("j1"))
    cool, hot = sized.filter(F.col("k").between(2, most)), sized.filter(F.col("k") > most)
    size, hot_rows = sized.agg(F.sum(F.when(F.col("k").between(2, most), F.length("bytes"))), F.count(F.when(F.col("k") > most, 1))).first()
    buckets = max(1, math.ceil((size or 0) / SORT_BYTES))
    dealt = cool.select("g", "s", "n", "m", "bytes", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    # dealt by number, which keeps Spark from putting many sorts into one task
    found = alone.union(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sorted_bucket(width), FOUND))
    if not hot_rows:
        return found
    halves = reliable_checkpoint(hot.select("g", "s", "n", "x", "y", "ref", "m", "bytes").mapInArrow(_divide(width), "pg long, ps long, base int, " + SPAN))
    merged = halves.groupBy("g", "s", "x", "y").agg(F.sum("n").alias("n"), F.min(F.struct("ref", "m", "bytes")).alias("v")).select("g", "s", "n", "x", "y", "v.*")
    below = repeated_in_spans(merged, width, most)
    again = halves.select("pg", "ps", "base", "g", "s").join(below, ["g", "s"]).select(F.col("pg").alias("g"), F.col("ps").alias("s"), (F.col("base") + F.col("j0")).alias("j0"), (F.col("base") + F.col("j1")).alias("j1"))
    return found.union(again)


def repeated_ranges(docs: DataFrame, width: int = WIDTH, most: int = MOST_SPANS) -> DataFrame:
    """``key, lo, hi``: ranges of starts of repeated strings, for ``docs`` with columns ``key`` and ``text``."""
    hits = reliable_checkpoint(repeated(reliable_checkpoint(docs.select("key", "text").mapInArrow(_anchor_rows(width), ROW))))
    whole = hits.filter("lone").select("key", "lo", "hi")
    spans = docs.join(places_by_row(distinct_spans(hits)), "key").select("text", "places").mapInArrow(_span_bytes(width), SPAN)
    found = repeated_in_spans(reliable_checkpoint(spans.dropDuplicates(["g", "s"])), width, most)
    partial = hits.filter(~F.col("lone")).join(found.withColumnRenamed("g", "a"), ["a", "s"])
    return whole.union(partial.select("key", (F.col("lo") + F.col("j0")).alias("lo"), (F.col("lo") + F.col("j1")).alias("hi")))


def byte_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, most: int = MOST_SPANS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept``.

    Texts are UTF-8 bytes, null counts as empty; a byte goes if a ``width``-byte string over it also
    starts anywhere else. Strings never cross documents and may overlap. ``n_spans`` counts maximal
    removed runs. Texts shorter than ``width`` stay whole. A repeated row is one more document. Null ids
    are allowed; other columns are ignored; an empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col).withColumn("key", row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    ranges = ranges_by_row(repeated_ranges(rows, width, most))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, cuts = text_bytes(batch.column(1))
            gone = covered(cuts, batch.column(2), width)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = cuts[:-1][np.diff(cuts) > 0]
            begins[inner] = gone[inner]
            out = []
            for k in range(batch.num_rows):
                row = slice(cuts[k], cuts[k + 1])
                kept = data[row][~gone[row]].tobytes()
                out.append((int(cuts[k + 1] - cuts[k]), int(gone[row].sum()), int(begins[row].sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                arrays.append(pa.array(columns[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([rows.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return rows.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema.add("kept", "binary") if with_bytes else schema)
