"""Content-defined anchors: which windows of a corpus can have an equal elsewhere.

Each window of ``width`` symbols chooses one of the ``part``-symbol strings in it, the one with the least
hash, leftmost on ties. The choice depends on the window's content only, so equal windows choose equal
anchors. Windows next to each other that choose the same place form a span; a span holds at most
2 * width - part symbols. A window can be repeated only if its anchor is.

The anchors are one row for about (width - part) / 2 symbols, which is what the first shuffle moves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import reliable_checkpoint
from tidewell.llm.tokens import Windows

#: Columns of an anchor row: hashes of anchor and span, row key, first and last window start, anchor start.
ROW = "a long, s long, key long, lo int, hi int, at int"


@dataclass
class Spans:
    row: np.ndarray  # index of the row in the slice
    low: np.ndarray  # first window start, in the slice
    high: np.ndarray  # last window start
    at: np.ndarray  # anchor start
    anchor: np.ndarray
    span: np.ndarray


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row by id and text; rows that agree in both share it, and have equal results."""
    return F.xxhash64(doc_id.cast("string"), text)


def spans_of(values: np.ndarray, cuts: np.ndarray, width: int, part: int) -> Spans:
    """Spans of all rows of a slice; row k has values[cuts[k]:cuts[k + 1]]."""
    n = len(values)
    if n < width:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64))
    windows = Windows(values)
    at = np.arange(n - part + 1)
    g = windows.hash(at, at + part)
    least, step, places = at.astype(np.int32), 1, width - part + 1
    while 2 * step <= places:
        left, right = least[: len(least) - step], least[step:]
        least = np.where(g[left] <= g[right], left, right)
        step *= 2
    count = len(g) - places + 1
    left, right = least[:count], least[places - step : places - step + count]
    least = np.where(g[left] <= g[right], left, right)
    sizes = np.diff(cuts)
    inside = np.zeros(n + 1, np.int8)  # window starts of each row
    long = sizes >= width
    inside[cuts[:-1][long]] += 1
    inside[cuts[1:][long] - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    place = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    low = starts[first]
    high = starts[np.append(first[1:], len(starts)) - 1] if len(first) else low
    place = place[first].astype(np.int64)
    return Spans(np.searchsorted(cuts, low, "right") - 1, low, high, place, g[place], windows.hash(low, high + width))


def repeated(rows: DataFrame) -> DataFrame:
    """Anchor rows whose anchor occurs again; ``lone`` if all its occurrences lie in equal spans.

    Then every window of these spans is repeated. Counted with partial sums and written, so that the
    join back stands alone and Spark can split it where an anchor is hot.
    """
    groups = rows.groupBy("a").agg(F.count("*").alias("c"), F.min("s").alias("s0"), F.max("s").alias("s1")).filter("c > 1")
    return rows.join(reliable_checkpoint(groups.select("a", (F.col("s0") == F.col("s1")).alias("lone"))), "a")


def distinct_spans(hits: DataFrame) -> DataFrame:
    """One row per distinct span of the anchors that are not lone: ``a, s, n`` and one place where it stands."""
    place = F.min(F.struct("key", "lo", "hi", "at")).alias("place")
    return hits.filter(~F.col("lone")).groupBy("a", "s").agg(F.count("*").alias("n"), place).select("a", "s", "n", "place.*")


def places_by_row(spans: DataFrame) -> DataFrame:
    """The places of each row as a list, whose length is bounded by the row's own text."""
    return spans.groupBy("key").agg(F.collect_list(F.struct("a", "s", "n", "lo", "hi", "at")).alias("places"))


def ranges_by_row(ranges: DataFrame) -> DataFrame:
    """Ranges of repeated window starts (``key, lo, hi``) of each row as a list; equal ones count once."""
    return ranges.distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
