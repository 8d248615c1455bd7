"""Exact search for the most similar series of each user (JN16, ARR9), by blocks with bounds.

Only series of equal length can be similar. Their unit vectors are ordered by the angle to a fixed axis
(the vector of ones) and cut into blocks. Two vectors differ by at least the difference of these angles, so
once a row knows how far its k-th best neighbour in its own block is, blocks beyond that angle are left out.
Blocks that remain meet in pairs; a pair compares prefixes first, and the whole vectors only where the
prefix and the lengths of the rests can still reach the k-th best. No pair of users is written that is not
among the best of its block pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import sequenced
from tidewell.operators.timelines import latest_per
from tidewell.session import reliable_checkpoint

#: Rows of a block at least, and blocks at most: the table of block bounds, which every task gets, is bounded by these.
BLOCK_ROWS = 1000
MOST_BLOCKS = 65_536
#: Rows of one side compared at a time.
CHUNK = 256
#: Angles and similarities are widened by this much, far above rounding.
SLACK = 1e-6

PACKED = "n long, block long, ids array<long>, queries array<boolean>, kth array<double>, unit binary, targets array<long>"
FOUND = "a long, b long, similarity double"


def unit_vectors(series: DataFrame) -> DataFrame:
    """``user_id, n, unit, angle`` of every series that is not all zeros; a series is one array of its ``n`` values."""
    rows = series.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "risk"))), lambda e: e["risk"].cast("double")).alias("v"))
    add = lambda a, x: a + x
    rows = rows.select("user_id", F.size("v").cast("long").alias("n"), "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("_norm")).filter("_norm > 0")
    rows = rows.select("user_id", "n", F.transform("v", lambda x: x / F.col("_norm")).alias("unit"))
    cosine = F.aggregate("unit", F.lit(0.0), add) / F.sqrt("n")
    return rows.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def _rounded(x: np.ndarray) -> np.ndarray:
    """As ``functions.numeric.r9``: what results are compared on."""
    return np.floor(x * 1e9 + 0.501) / 1e9


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, n)


def best_pairs(left: np.ndarray, right: np.ndarray, kth: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k (row, column, similarity) per row of ``left``: similarity of ``kth`` at least, best first, ties by id.

    ``kth`` holds the least similarity that still counts per row.
    """
    half = max(1, left.shape[1] // 4)
    tail_l, tail_r = (np.sqrt(np.maximum(0.0, (x[:, half:] ** 2).sum(axis=1))) for x in (left, right))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(left), CHUNK):
        rows = slice(start, min(start + CHUNK, len(left)))
        least = kth[rows] - SLACK
        # what the prefix leaves open is at most the product of the lengths of the rests
        bound = left[rows, :half] @ right[:, :half].T + tail_l[rows, None] * tail_r[None, :]
        i, j = np.nonzero(bound >= least[:, None])
        if len(i) > bound.size // 8:
            similarity = (left[rows] @ right.T)[i, j]
        else:
            similarity = np.einsum("ij,ij->i", left[rows][i], right[j])
        similarity = _rounded(similarity)
        keep = (similarity >= least[i]) & (similarity > 0) & (left_ids[rows][i] != right_ids[j])
        i, j, similarity = i[keep], j[keep], similarity[keep]
        order = np.lexsort((right_ids[j], -similarity, i))
        i, j, similarity = i[order], j[order], similarity[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[place < k] + start, j[place < k], similarity[place < k]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _pack(bounds: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """A block's rows in one row, with the k-th best of each in the block and the blocks that could hold better ones."""

    def run(rows: pa.Table) -> pa.Table:
        ids, asks, angle = (rows.column(c).to_numpy() for c in ("user_id", "query", "angle"))
        n = rows.column("n")[0].as_py()
        unit = rows.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), n)
        at, _, similarity = best_pairs(unit, unit, np.full(len(ids), SLACK), ids, ids, k)
        count = np.bincount(at, minlength=len(ids))
        kth = np.zeros(len(ids))
        full = count >= k
        kth[full] = similarity[(np.cumsum(count) - 1)[full]]
        reach = np.arccos(np.clip(kth - SLACK, -1, 1)) + SLACK
        low, high = bounds[n]
        first = np.searchsorted(high, (angle - reach)[asks], "left")
        last = np.searchsorted(low, (angle + reach)[asks], "right")
        step = np.bincount(first, minlength=len(low) + 1) - np.bincount(np.maximum(first, last), minlength=len(low) + 1)
        targets = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        return pa.table([[n], [rows.column("block")[0].as_py()], [ids.tolist()], [asks.tolist()], [kth.tolist()], [unit.astype(np.float64).tobytes()], [targets.tolist()]], schema=_schema())

    return run


def _schema() -> pa.Schema:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64()))
    return pa.schema(list(zip(("n", "block", "ids", "queries", "kth", "unit", "targets"), kinds)))


def _compare(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, own, asks, kth, other = batch.column(0)[row].as_py(), *(batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3, 5))
                left, right = (_matrix(batch.column(c)[row].as_buffer(), n) for c in (4, 6))
                i, j, similarity = best_pairs(left[asks], right, kth[asks], own[asks], other, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[asks][i]), pa.array(other[j]), pa.array(similarity)], ["a", "b", "similarity"])

    return run


def top_similar(series: DataFrame, k: int = 5, research: bool = False, queries: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` users whose series are most similar to each user's: ``a, b, similarity, rank`` (JN16).

    ``series`` has ``user_id, pos, risk`` with a numeric user id; values meet by order. Similarity is the
    cosine, rounded to nine digits; ties go to the smaller id. Series of different length, or all zeros, have
    similarity 0, and such pairs are left out, as are negative ones. ``queries`` (``user_id``) restricts
    ``a``; all users are searched. The result is exact. Comparing users needs the research flag.
    """
    if not research:
        raise PermissionError("comparing users needs research=True")
    rows = unit_vectors(series.filter("user_id IS NOT NULL AND risk IS NOT NULL"))
    if queries is None:
        rows = rows.withColumn("query", F.lit(True))
    else:
        asked = queries.select("user_id").distinct().withColumn("query", F.lit(True))
        rows = rows.join(asked, "user_id", "left").withColumn("query", F.coalesce("query", F.lit(False)))
    rows = reliable_checkpoint(rows.withColumn("user_id", F.col("user_id").cast("long")))
    # a length with few rows has one block; a block has block_rows at least, and all of them together at most MOST_BLOCKS besides one per length
    size = max(block_rows, rows.count() // MOST_BLOCKS)
    placed = sequenced(rows, ["n"], ["angle", "user_id"], total="total")
    blocks = F.greatest(F.lit(1), F.floor(F.col("total") / size))
    placed = reliable_checkpoint(placed.withColumn("block", F.floor((F.col("pos") - 1) * blocks / F.col("total"))).drop("pos", "total"))
    held: dict[int, list[tuple[int, float, float]]] = {}
    for r in placed.groupBy("n", "block").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")).toLocalIterator():
        held.setdefault(r["n"], []).append((r["block"], r["lo"], r["hi"]))
    bounds = {n: tuple(np.array([b[c] for b in sorted(found)]) for c in (1, 2)) for n, found in held.items()}
    packed = reliable_checkpoint(placed.groupBy("n", "block").applyInArrow(_pack(bounds, k), PACKED))
    pairs = packed.select("n", "ids", "queries", "kth", "unit", F.explode("targets").alias("block"))
    other = packed.select("n", "block", F.col("ids").alias("other_ids"), F.col("unit").alias("other_unit"))
    met = pairs.join(other, ["n", "block"]).select("n", "ids", "queries", "kth", "unit", "other_ids", "other_unit")
    found = met.mapInArrow(_compare(k), FOUND)
    return latest_per(found, ["a"], [F.desc("similarity"), F.col("b")], k).withColumn("rank", F.col("rank").cast("long"))
