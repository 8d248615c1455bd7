"""Hard-negative mining by inner product, with coordinate pruning in length buckets.

Components are scaled and floored to integers, so scores are exact. Rows are dealt by sampled ranges of
their length and read, longest first, in buckets of about equal length. A bucket holds, for every
coordinate, the sorted list of its rows' unit values. For an anchor and the least score that still
counts, the angle between the two is bounded, and by the triangle inequality so is the angle between a
row and each axis: an anchor's focus coordinates (the largest of its unit vector) give ranges in their
lists. Rows in the ranges of all focus coordinates are candidates and are scored exactly; a bucket
whose greatest length cannot reach the score is left out.

First the nearest rows of an anchor's own label are found, then, between the bounds that their scores
set, rows of other labels. The least score rises as results are found. Anchors are the stated query set:
they are taken in blocks of ``ANCHORS``, each block sent to one pass over all rows. A task keeps a
bucket and a few rows per anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import reliable_checkpoint, row_numbers, work_folder

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these hundredths of the positive's score.
BAND = (50, 95)
#: Anchors sent to a pass at a time; rows in a length bucket; rows in a written range of lengths.
ANCHORS = 2048
BUCKET_ROWS = 2048
RANGE_ROWS = 8192
#: Coordinates whose ranges are intersected.
FOCUS = 3
#: Slack of angles and unit values, far above rounding.
SLACK = 1e-7

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _most(size: int) -> int:
    """Greatest component for which every inner product of vectors of ``size`` fits 64 bits and a component 32."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // max(size, 1)))


def prepared(embeddings: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: float = SCALE) -> DataFrame:
    """``id, label, anchor, size, norm2, v`` of the rows that take part; ``v`` holds the integers, 32 bits each."""
    kind = F.col(label) if isinstance(label, str) else label
    asks = F.coalesce(anchor, F.lit(False)).alias("anchor")
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), kind.cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), asks).dropna()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            values = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False))  # a null component is not a number
            counts = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            limit = np.array([_most(n) for n in range(int(counts.max(initial=0)) + 1)], np.float64)[counts]
            good = np.bincount(row[~(np.abs(values) <= limit[row])], minlength=len(counts)) == 0
            keep = pa.array(good)
            kept = values[good[row]].astype(np.int32)
            sizes = counts[good]
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            squares = np.concatenate(([0], np.cumsum(kept.astype(np.int64) ** 2)))  # wraps, but differences of it do not
            raw = kept.tobytes()
            vectors = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).filter(keep) for k in (0, 1, 3)), pa.array(sizes), pa.array(squares[cuts[1:]] - squares[cuts[:-1]]), pa.array(vectors, pa.binary())],
                ["id", "label", "anchor", "size", "norm2", "v"],
            )

    return rows.mapInArrow(run, "id long, label string, anchor boolean, size long, norm2 long, v binary")


@dataclass
class Anchors:
    """A block of the query set. ``least`` and ``most`` are, per anchor, the score bounds of its distinct positive scores."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray  # code in ``labels``
    labels: dict[str, int]
    vectors: list[np.ndarray]
    bounds: list[list[tuple[int, int, int]]] = field(default_factory=list)  # (positive score, least, most)


class Bucket:
    """Rows of one dimension and about one length, with a sorted list of unit values per coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, vectors
        self.exact = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1]
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.short, self.long = float(length.min()), float(length.max())
        self.wide = vectors.astype(np.float64)
        self.unit = (self.wide / np.maximum(length, 1e-300)[:, None]).T.copy()  # a list per coordinate
        self.order = np.argsort(self.unit, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=1)

    def candidates(self, unit: np.ndarray, length: float, focus: np.ndarray, least: int | None) -> np.ndarray | None:
        """Rows that may score ``least`` with an anchor of this unit vector and length; None means all."""
        if least is None or length == 0 or (self.short == 0 and least <= 0):
            return None if least is None or least <= 0 else np.zeros(0, np.int64)
        cosine = least / (length * (self.long if least > 0 else self.short)) if self.long else math.inf
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        angle = math.acos(min(cosine, 1.0)) + SLACK
        found, best = [], None
        for f in focus.tolist():
            axis = math.acos(max(-1.0, min(1.0, float(unit[f]))))
            low, high = math.cos(min(math.pi, axis + angle)) - SLACK, math.cos(max(0.0, axis - angle)) + SLACK
            a, b = (int(x) for x in np.searchsorted(self.sorted[f], (low, high)))
            found.append((f, low, high))
            if best is None or b - a < best[2] - best[1]:
                best = (f, a, b)
        f, a, b = best
        if b - a == len(self.ids):
            return None
        rows = self.order[f, a:b]
        for g, low, high in found:
            if g != f and len(rows):
                value = self.unit[g].take(rows)
                rows = rows[(value >= low) & (value <= high)]
        return rows

    def scores(self, rows: np.ndarray | None, anchor: np.ndarray) -> np.ndarray:
        most = float(np.abs(anchor).max(initial=0))
        exact = most * math.sqrt(self.exact * len(anchor)) < 2.0**52  # then doubles are exact, whatever the order of sums
        if exact:
            return ((self.wide if rows is None else self.wide[rows]) @ anchor.astype(np.float64)).astype(np.int64)
        return (self.v if rows is None else self.v[rows]).astype(np.int64) @ anchor.astype(np.int64)


def _buckets(batches: Iterable[pa.RecordBatch], labels: dict[str, int], rows: int) -> Iterator[Bucket]:
    """Consecutive rows of one dimension; batches hold ``id, label, size, v``."""
    for batch in batches:
        size = batch.column(2).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(size)) + 1, [len(size)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for start in range(a, b, rows):
                part = batch.slice(start, min(rows, b - start))
                v = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).reshape(part.num_rows, int(size[start]))
                codes = np.array([labels.get(x, -1) for x in part.column(1).to_pylist()], np.int64)
                yield Bucket(part.column(0).to_numpy(), codes, v)


def _best(score: np.ndarray, ids: np.ndarray, held: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The first k of (-score, id), with those held before."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= cut
        score, ids = score[keep], ids[keep]
    return sorted([*held, *zip((-score).tolist(), ids.tolist())])[:k]


def _search(shared, rows: int, focus: int, k: int, own: bool):
    """One task's best rows: of the anchor's own label, or, between its bounds, of other labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Anchors = shared.value
        n = len(block.number)
        bounds = [[(0, None, None)]] * n if own else block.bounds
        held: list[list[list[tuple[int, int]]]] = [[[] for _ in b] for b in bounds]
        lengths = [math.sqrt(float((v.astype(np.float64) ** 2).sum())) for v in block.vectors]
        units = [v / x if x else v.astype(np.float64) for v, x in zip(block.vectors, lengths)]
        focuses = [np.argsort(-np.abs(u), kind="stable")[:focus] for u in units]
        for bucket in _buckets(batches, block.labels, rows):
            for j in range(n):
                anchor = block.vectors[j]
                if len(anchor) != bucket.v.shape[1] or not bounds[j]:
                    continue
                # a row counts for a bound if it scores what the bound asks, and what the k-th so far has
                least = [x if len(h) < k else -h[-1][0] if x is None else max(x, -h[-1][0]) for h, (_, x, _) in zip(held[j], bounds[j])]
                lowest = None if None in least else min(least)
                found = bucket.candidates(units[j], lengths[j], focuses[j], lowest)
                if found is not None and not len(found):
                    continue
                score = bucket.scores(found, anchor)
                ids, label = (bucket.ids, bucket.labels) if found is None else (bucket.ids[found], bucket.labels[found])
                side = (label == block.label[j]) & (ids != block.id[j]) if own else label != block.label[j]
                if lowest is not None:
                    side &= score >= lowest
                score, ids = score[side], ids[side]
                if not len(score):
                    continue
                for b, (_, _, most) in enumerate(bounds[j]):
                    fits = np.ones(len(score), bool)
                    if least[b] is not None:
                        fits &= score >= least[b]
                    if most is not None:
                        fits &= score <= most
                    if fits.any():
                        held[j][b] = _best(score[fits], ids[fits], held[j][b], k)
        out = [(int(block.number[j]), p, -s, i) for j in range(n) for h, (p, _, _) in zip(held[j], bounds[j]) for s, i in h]
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "bound", "score", "id"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "bound").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_of(rows: list, positives: dict[int, list[int]] | None, band: tuple[int, int]) -> Anchors:
    names = {x: k for k, x in enumerate(sorted({r["label"] for r in rows}))}
    block = Anchors(np.array([r["pos"] for r in rows]), np.array([r["id"] for r in rows]), np.array([names[r["label"]] for r in rows]), names, [np.frombuffer(bytes(r["v"]), np.int32) for r in rows])
    if positives is not None:
        low, high = band
        for n in block.number.tolist():
            # low * p <= 100 * score <= high * p, in integers; a negative p leaves nothing
            block.bounds.append([(p, -(-low * p // 100), high * p // 100) for p in sorted(set(positives.get(n, ())), reverse=True) if p >= 0])
    return block


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
    scale: float = SCALE,
    anchors_at_a_time: int = ANCHORS,
    bucket_rows: int = BUCKET_ROWS,
    range_rows: int = RANGE_ROWS,
    focus: int = FOCUS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors (null: not). For an anchor and each of its first ``positives``
    rows of the same label, the first ``negatives`` rows of other labels whose score lies within ``band``
    percent of the positive's; higher scores first, then smaller ids. ``rank`` counts from 1.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those
    with a scaled component so large that an inner product could leave 64 bits. Vectors of different
    dimension do not meet. Vectors of zeros and empty vectors score 0. Repeated rows count as often as they
    stand, as anchors too; a row is not its own positive, nor is one with the same id. Other columns are
    ignored; an empty table, or one without anchors, gives no rows.
    """
    rows = reliable_checkpoint(prepared(embeddings, anchor, id_col, vector_col, label, scale))
    ranges = max(1, -(-rows.count() // range_rows))
    by_length = [F.col("size"), F.col("norm2").desc(), F.xxhash64("id")]
    dealt = reliable_checkpoint(rows.repartitionByRange(ranges, *by_length).sortWithinPartitions(*by_length)).select("id", "label", "size", "v")
    chosen = row_numbers(reliable_checkpoint(rows.filter("anchor").select("id", "label", "v", F.lit(0).alias("all"), F.monotonically_increasing_id().alias("_at"))), "all")
    chosen = reliable_checkpoint(chosen.select("pos", "id", "label", "v"))
    spark, folder, parts = embeddings.sparkSession, work_folder(embeddings.sparkSession, "negatives"), []
    schema = "anchor long, bound long, score long, id long"
    for start in range(0, chosen.count(), anchors_at_a_time):
        block = chosen.filter(F.col("pos").between(start, start + anchors_at_a_time - 1)).collect()
        pass_one = dealt.mapInArrow(_search(spark.sparkContext.broadcast(_block_of(block, None, band)), bucket_rows, focus, positives, True), schema)
        near = reliable_checkpoint(_first(pass_one, positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("bound"), F.col("rank").alias("place")))
        scores: dict[int, list[int]] = {}
        for r in near.select("anchor", "bound").collect():  # at most ``positives`` per anchor of the block
            scores.setdefault(r["anchor"], []).append(r["bound"])
        pass_two = dealt.mapInArrow(_search(spark.sparkContext.broadcast(_block_of(block, scores, band)), bucket_rows, focus, negatives, False), schema)
        far = _first(pass_two, negatives).select("anchor", "bound", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        ids = chosen.select(F.col("pos").alias("anchor"), F.col("id").alias("anchor_id"))
        result = near.join(far, ["anchor", "bound"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("bound").alias("positive_score"), "negative_score")
        parts.append(f"{folder}/{len(parts)}")
        result.write.parquet(parts[-1])
    if not parts:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*parts)
