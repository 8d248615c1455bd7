"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a fixed sparse random index vector. A word's vector is the sum of the index vectors of
its neighbours (two on each side), over all documents. Words are hashed into ``WORDS`` rows, so the
vectors have a fixed size whatever the corpus, and can be broadcast. A document is the mean and the
spread of its words' vectors and the size of the steps from word to word. The network is trained in numpy on a bounded sample of labelled rows; a
temperature, fitted on the part of the sample that was kept out of training, calibrates the score.

Words are runs of one kind of character: letters (lower case, or with a capital), capitals, digits, and
other signs. Nothing but the text enters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import crc_mod, id_text, reliable_checkpoint, slices, text_bytes
from tidewell.llm.tokens import BYTE_CODE, window_hashes

WORDS = 1 << 13
SIZE = 32
POOL = 3 * SIZE
#: Non-zero entries of an index vector, half of them negative.
NONZERO = 4
REACH = 2
#: Labelled rows that the network is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
HIDDEN = 16
STEPS = 400
SLICE = 1 << 20

KIND = np.full(256, 5, np.uint8)
KIND[[*b" \t\n\r\x0b\x0c"]] = 0
KIND[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 1
KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
KIND[[*b"0123456789"]] = 3

_RNG = np.random.default_rng(7)
INDEX_AT = _RNG.integers(0, SIZE, (WORDS, NONZERO))
INDEX_SIGN = np.tile([1, -1], NONZERO // 2)


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of the vector table of each word, and the n+1 offsets of the documents."""
    data, bounds = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    kind = KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) & ~((kind[1:] == 1) & (kind[:-1] == 2))
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    numbers = (window_hashes(BYTE_CODE[data], starts, ends) % np.uint64(WORDS)).astype(np.int64)
    return numbers, np.searchsorted(starts, bounds)


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WORDS * SIZE)
    seen = np.zeros(WORDS, bool)
    for batch in slices(batches, limit=SLICE):
        numbers, cuts = word_numbers(batch.column(0))
        document = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        seen[numbers] = True
        for step in range(1, REACH + 1):
            a, b = numbers[:-step], numbers[step:]
            near = document[:-step] == document[step:]
            a, b = a[near], b[near]
            for k in range(NONZERO):
                total += INDEX_SIGN[k] * (np.bincount(a * SIZE + INDEX_AT[b, k], minlength=len(total)) + np.bincount(b * SIZE + INDEX_AT[a, k], minlength=len(total)))
    held = np.flatnonzero(seen)
    table = total.reshape(WORDS, SIZE)[held].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(table[:, k]) for k in range(SIZE))], ["word", *(f"v{k}" for k in range(SIZE))])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The vector table, WORDS x SIZE, rows of unit length; summed over all texts (column ``text``)."""
    schema = "word long, " + ", ".join(f"v{k} long" for k in range(SIZE))
    sums = texts.select("text").mapInArrow(_contexts, schema).groupBy("word").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(SIZE)])
    table = np.zeros((WORDS, SIZE), np.float32)
    for row in sums.collect():  # at most WORDS rows
        table[row[0]] = row[1:]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.maximum(norm, 1e-9)


def pooled(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, pool``: mean, spread and steps of the word vectors of each text; zeros for one without words."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in slices(batches, limit=SLICE):
            numbers, cuts = word_numbers(batch.column(1))
            out = np.zeros((batch.num_rows, POOL), np.float32)
            some = np.flatnonzero(np.diff(cuts) > 0)
            if len(some):
                got = vectors[numbers]
                count = np.diff(cuts)[some, None]
                mean = np.add.reduceat(got, cuts[some], axis=0) / count
                square = np.add.reduceat(got * got, cuts[some], axis=0) / count
                step = np.zeros_like(got)
                step[1:] = got[1:] - got[:-1]
                step[cuts[some]] = 0
                steps = np.add.reduceat(step * step, cuts[some], axis=0) / np.maximum(count - 1, 1)
                out[some] = np.concatenate((mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.sqrt(steps)), axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, POOL), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "pool"])

    return rows.select("doc_id", "text").mapInArrow(run, T.StructType([rows.schema["doc_id"]]).add("pool", T.ArrayType(T.FloatType())))


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Fit on four fifths of the rows; the temperature on the rest. One class alone gives its smoothed share."""
    n = len(x)
    width = x.shape[1] if n else POOL
    rng = np.random.default_rng(seed)
    net = Network(x.mean(axis=0) if n else np.zeros(width), x.std(axis=0) + 1e-6 if n else np.ones(width), rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    share = (y.sum() + 1) / (n + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if n < 10 or len(np.unique(y)) < 2:
        return net
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    order = rng.permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    z, target = (x[used] - net.centre) / net.scale, y[used]
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = weights
        h = np.tanh(z @ w1 + b1)
        p = 1.0 / (1.0 + np.exp(-np.clip(h @ w2 + b2[0], -60, 60)))
        d = (p - target) / len(used)
        back = np.outer(d, w2) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    logits, truth = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(truth > 0, logits, -logits) / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Labels are learned only from rows whose crc32(id) mod ``modulus`` is not ``held_out``; null labels and
    ids teach nothing, of several labels of an id the smallest counts. Null and empty texts have a score
    too, that of a document without words. Without labels all scores are one half. Repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col)
    vectors = reliable_checkpoint(pooled(rows, word_vectors(rows)))
    known = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    taught = vectors.filter(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held_out)).join(known, "doc_id")
    # of far more labelled rows only those that can be among the smallest hashes go to the one task that picks
    hashed, count = F.xxhash64("doc_id"), taught.select("doc_id").count()
    least = int(2**64 * min(1.0, 1.5 * sample_rows / max(count, 1))) - 2**63 - 1
    sample = taught.filter(hashed <= F.lit(least)).orderBy(hashed, "doc_id").limit(sample_rows).select("pool", "label").toArrow()
    flat = sample.column("pool").combine_chunks().flatten().to_numpy(zero_copy_only=False) if sample.num_rows else np.zeros(0, np.float32)
    net = train(flat.reshape(-1, POOL).astype(np.float64), (sample.column("label").to_numpy() > 0).astype(np.float64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = net.score(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, POOL).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([vectors.schema["doc_id"]]).add("held_out", "boolean").add("score", "double").add("predicted", T.IntegerType())
    return vectors.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == held_out).alias("held_out"), "pool").mapInArrow(run, schema)
