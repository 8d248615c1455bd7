"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within three bits of each other have a variant in the middle: one bit from one of them and
at most two from the other. Every distinct fingerprint emits the variants within one bit, and, if its
number of set bits is odd, those two bits away (of three differing bits one side is odd, the other even;
and two of the three lie in the same half of the 64 bits, so pairs of bits within a half are enough).

All that meet at a variant are linked by the triangle inequality as soon as one of them is within one
bit of it, so a variant yields a star around one such fingerprint and never all pairs. To spare the
shuffle of about a thousand rows a fingerprint, rows are dealt by the half of the variant that the pair
of bits leaves alone (66 rows a fingerprint) and the other half's variants are made where they meet.
Links are verified again before they leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SMALL_SLICE, id_text, reliable_checkpoint, slices, text_bytes
from tidewell.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Rows of variants that one group holds, on average.
BUCKET_ROWS = 400_000
#: Fingerprints whose two-bit variants are made at a time.
BLOCK = 1000


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles of a text; 0 for a text without words."""
    words = raw.lower().split()  # bytes: lower-cases A-Z and splits at blanks \x09-\x0d and \x20 only
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size))))], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    n = len(h)
    lanes = np.uint64(0x0101010101010101)
    out = 0
    for k in range(8):  # eight counters to a word, summed in runs short enough for a byte
        bits = (h >> np.uint64(k)) & lanes
        sums = np.add.reduceat(bits, np.arange(0, n, 255)).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * sums > n).tolist():
            out |= 1 << (8 * byte + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``doc_id, fp`` (as a signed long) of every row, and ``_key`` if a key is named."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            data, bounds = text_bytes(batch.column(1))
            raw, cuts = data.tobytes(), bounds.tolist()
            made = np.array([fingerprint(raw[a:b]) for a, b in zip(cuts, cuts[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    rows = id_text(docs, id_col, text_col, key_col)
    key = f", _key {rows.schema['_key'].dataType.simpleString()}" if key_col else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long{key}")


def _pairs(shift: int) -> np.ndarray:
    one = [1 << (shift + k) for k in range(32)]
    return np.array([one[i] | one[j] for i in range(32) for j in range(i)], np.uint64)


def _links(rows: pa.Table) -> pa.Table:
    """Star links among the fingerprints of one bucket of variants."""
    fp = rows.column("fp").to_numpy().view(np.uint64)
    part = rows.column("part").to_numpy().astype(np.int64)
    side, flip = part // 33, part % 33
    one = np.uint64(1)
    moved = flip > 0  # the flipped bit lies in the half that rows are dealt by
    bit = one << (np.where(side == 0, 32, 0) + flip - 1)[moved].astype(np.uint64)
    near, source = [fp[moved] ^ bit, fp[~moved]], [fp[moved], fp[~moved]]
    for s, low in ((0, 0), (1, 32)):
        own = fp[~moved & (side == s)]
        for k in range(low, low + 32):
            near.append(own ^ (one << np.uint64(k)))
            source.append(own)
    v, f = np.concatenate(near), np.concatenate(source)
    order = np.argsort(v, kind="stable")
    v, f = v[order], f[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    middle = v[first]
    centre = np.minimum.reduceat(f, first) if len(v) else f
    found = [np.stack((f, np.repeat(centre, np.diff(np.append(first, len(v))))), 1)]
    found[0] = np.unique(found[0][found[0][:, 0] != found[0][:, 1]], axis=0)
    for s, low in ((0, 0), (1, 32)):
        own = fp[~moved & (side == s)]
        own = own[np.bitwise_count(own) % 2 == 1]
        flips = _pairs(low)
        for k in range(0, len(own), BLOCK):
            far = (own[k : k + BLOCK, None] ^ flips[None, :]).ravel()
            at = np.minimum(np.searchsorted(middle, far), max(len(middle) - 1, 0))
            hit = np.flatnonzero(middle[at] == far)
            if len(hit):
                found.append(np.unique(np.stack((own[k + hit // len(flips)], centre[at[hit]]), 1), axis=0))
    links = np.unique(np.concatenate(found), axis=0)
    links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= RADIUS]
    links = links[links[:, 0] != links[:, 1]].view(np.int64)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within three bits; ``distinct`` has one column ``fp``."""
    buckets = max(1, math.ceil(distinct.count() * 66 / BUCKET_ROWS))
    part = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("part")
    half = F.expr("CASE WHEN part < 33 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    key = half.bitwiseXOR(F.expr("CASE WHEN part % 33 = 0 THEN 0L ELSE shiftleft(1L, part % 33 - 1) END"))
    rows = distinct.select("fp", part).select("fp", F.col("part").cast("tinyint").alias("part"), F.pmod(F.xxhash64(F.col("part") < 33, key), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(lambda t: _links(t), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Texts are taken whole; null and empty texts have fingerprint zero, which links like any other. The
    component is named by the smallest id in it. Equal fingerprints are one node, so groups of copies
    cost one row. Repeated rows and ids give a row each; a null id is never the smallest unless alone.
    Other columns are ignored; an empty table gives no rows. With ``key_col``, a column that differs from
    row to row, the result has it as ``_key``, and as ``root`` a fingerprint that names the component even
    where ids are null or repeated.
    """
    rows = reliable_checkpoint(fingerprints(docs, id_col, text_col, key_col))
    nodes = reliable_checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = reliable_checkpoint(member)
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    label = member.select("fp", "root").join(named, "root").select("fp", "component_id", "root")
    return rows.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(["_key", "root"] if key_col else []))
