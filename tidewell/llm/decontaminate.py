"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of words (runs of letters, digits and non-ASCII characters, in
lower case). Windows of ``min_match`` words that both sides hold are the seeds. For each document and
item with a shared seed, the longest common runs of unmarked words are found by running Karp-Rabin
hashes and marked on both sides, then the next longest, until none of ``min_match`` words is left. The
share of the item's words under marks is its coverage: passages that were moved around are covered as
well as those in order. A document is contaminated if an item reaches ``threshold``.

The items are the stated query set. They are read in blocks of at most ``BLOCK_WORDS`` words and each
block is broadcast to one pass over the documents; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SMALL_SLICE, id_text, slices, text_bytes
from tidewell.llm.tokens import Windows, words

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_WORDS = 500_000

INSIDE = np.zeros(256, bool)
INSIDE[[*b"0123456789abcdefghijklmnopqrstuvwxyz_", *range(128, 256)]] = True


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text column, the row of each, and the n+1 offsets of the rows."""
    lowered = pa.array([t.lower() for t in column.fill_null("").to_pylist()], pa.large_string())
    data, bounds = text_bytes(lowered)
    _, _, hashes, rows = words(data, bounds, INSIDE)
    return hashes, rows, np.searchsorted(rows, np.arange(len(column) + 1))


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(len(hashes) - size + 1, 0))
    return Windows(hashes).hash(at, at + size)


def tiling(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length), longest first; ties by item position, then document position."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    least = min(min_match, len(item))
    size = len(item)
    tiles: list[tuple[int, int, int]] = []
    while least and size >= least:
        found = _longest(doc, item, free_d, free_i, size)
        if not found:
            size = size - 1 if size == least else max(size // 2, least)
            continue
        length = max(f[2] for f in found)
        for i, d, n in sorted((i, d, n) for d, i, n in found if n == length):
            if free_d[d : d + n].all() and free_i[i : i + n].all():
                free_d[d : d + n] = free_i[i : i + n] = False
                tiles.append((d, i, n))
    return tiles


def _longest(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches of unmarked words, of at least ``size`` words."""
    if len(doc) < size:
        return []
    clear = lambda free: np.convolve(~free, np.ones(size, int), "valid") == 0
    at_i, at_d = np.flatnonzero(clear(free_i)), np.flatnonzero(clear(free_d))
    hash_i, hash_d = windows_of(item, size)[at_i], windows_of(doc, size)[at_d]
    order = np.argsort(hash_i, kind="stable")
    low, high = np.searchsorted(hash_i[order], hash_d, "left"), np.searchsorted(hash_i[order], hash_d, "right")
    found = []
    for k in np.flatnonzero(high > low).tolist():
        d = int(at_d[k])
        for i in at_i[order[low[k] : high[k]]].tolist():
            if d and i and doc[d - 1] == item[i - 1] and free_d[d - 1] and free_i[i - 1]:
                continue  # begins further left
            n = size
            while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                n += 1
            found.append((d, i, n))
    return found


class Block:
    """Test items of one block: their words, and their seeds by length."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int):
        hashes, _, cuts = word_rows(pa.array(texts, pa.string()))
        self.min_match = min_match
        kept = [k for k in range(len(ids)) if cuts[k + 1] > cuts[k]]
        self.ids = [ids[k] for k in kept]
        self.items = [hashes[cuts[k] : cuts[k + 1]] for k in kept]
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, words_ in enumerate(self.items):
            size = min(min_match, len(words_))  # an item with fewer words counts as a whole
            by_size.setdefault(size, []).append((np.unique(windows_of(words_, size)), n))
        self.seeds = {}
        for size, parts in by_size.items():
            seed = np.concatenate([p for p, _ in parts])
            item = np.concatenate([np.full(len(p), n) for p, n in parts])
            order = np.argsort(seed, kind="stable")
            self.seeds[size] = seed[order], item[order]

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, float, int]]:
        """(row, item number, coverage, tiles) of each document and item that share a seed."""
        hashes, rows, cuts = word_rows(column)
        pairs: set[tuple[int, int]] = set()
        for size, (seed, item) in self.seeds.items():
            if len(hashes) < size:
                continue
            doc = windows_of(hashes, size)
            low = np.searchsorted(seed, doc, "left")
            inside = rows[: len(doc)] == rows[size - 1 :]
            at = np.flatnonzero(inside & (seed[np.minimum(low, len(seed) - 1)] == doc))
            for k, a, b in zip(at.tolist(), low[at].tolist(), np.searchsorted(seed, doc[at], "right").tolist()):
                pairs.update((int(rows[k]), n) for n in item[a:b].tolist())
        for row, n in sorted(pairs):
            tiles = tiling(hashes[cuts[row] : cuts[row + 1]], self.items[n], self.min_match)
            yield row, n, sum(t[2] for t in tiles) / len(self.items[n]), len(tiles)


def blocks(benchmark: DataFrame, min_match: int, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for row in id_text(benchmark, id_col, text_col).dropna(subset=["text"]).toLocalIterator():
        ids.append(row["doc_id"])
        texts.append(row["text"])
        size += len(row["text"].split())
        if size >= limit:
            yield Block(ids, texts, min_match)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, min_match)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, contaminated, n_items, coverage, item_id, n_tiles``.

    ``n_items`` counts items at or over the threshold; ``coverage``, ``item_id`` and ``n_tiles`` are those
    of the best item (ties: the one that is read first), or 0, null and 0 where no seed is shared. Null
    and empty texts share none; items without words are ignored; an empty benchmark leaves all clean.
    Repeated rows give repeated results; other columns are ignored. Texts are taken whole.
    """
    rows = _marked(id_text(docs, id_col, text_col), benchmark, "text", min_match, threshold, block_words)
    return rows.select("doc_id", (F.col("_n") > 0).alias("contaminated"), F.col("_n").alias("n_items"), F.col("_cover").alias("coverage"), F.col("_item").alias("item_id"), F.col("_tiles").alias("n_tiles"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _marked(whole, benchmark, "text", min_match, threshold, block_words).filter("_n = 0").select("_row.*")


def _marked(rows: DataFrame, benchmark: DataFrame, text: str, min_match: int, threshold: float, block_words: int) -> DataFrame:
    item_type = benchmark.schema["item_id"].dataType.simpleString() if "item_id" in benchmark.columns else "long"
    rows = rows.withColumns({"_n": F.lit(0).cast("long"), "_cover": F.lit(0.0), "_item": F.lit(None).cast(item_type), "_tiles": F.lit(0).cast("long")})
    for block in blocks(benchmark, min_match, limit=block_words):
        rows = _pass(rows, rows.sparkSession.sparkContext.broadcast(block), text, threshold)
    return rows


def _pass(rows: DataFrame, shared, text: str, threshold: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches, text, SMALL_SLICE):
            names = batch.schema.names
            n, cover, item, tiles = (batch.column(names.index(c)).to_pylist() for c in ("_n", "_cover", "_item", "_tiles"))
            for row, k, share, count in block.hits(batch.column(names.index(text))):
                n[row] += share >= threshold
                if share > cover[row]:
                    cover[row], item[row], tiles[row] = share, block.ids[k], count
            made = {"_n": n, "_cover": cover, "_item": item, "_tiles": tiles}
            yield pa.RecordBatch.from_arrays([pa.array(made[c], batch.column(i).type) if c in made else batch.column(i) for i, c in enumerate(names)], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)
