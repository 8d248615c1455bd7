"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf. The leaves of a tree are numbered in order and cut into aligned blocks of
``FANOUT ** HEIGHT``; a block is the subtree over its leaves, kept as one array of digests. Block roots
are the leaves of the next tier, until each tree has one block; the roots of the trees form one more tree.

Within a block the tree is cut at half its height: the top tree comes first, then the bottom trees from
left to right, each laid out by the same rule. The place of a node follows from its depth and number
alone (``addresses``), so a block is built, and the siblings on a path are read, without pointers, and a
path touches few cache lines whatever their size.

Leaves are dealt by sampled ranges of tree and order, so a tree that holds a third of the rows is many
partitions. No task holds more than a block; the driver sees tree sizes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import reliable_checkpoint, sorted_positions

FANOUT = 3
#: Levels below a block's root.
HEIGHT = 6
LEAVES = FANOUT**HEIGHT
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def slots(height: int) -> int:
    return (FANOUT ** (height + 1) - 1) // (FANOUT - 1)


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """Slot of every node of a tree with ``height`` levels below its root, by depth."""
    if height == 0:
        return (np.zeros(1, np.int64),)
    top = (height - 1) // 2  # height of the top tree
    bottom = height - top - 1
    trees = slots(top) + np.arange(FANOUT ** (top + 1)) * slots(bottom)
    return (*addresses(top), *((trees[:, None] + a).ravel() for a in addresses(bottom)))


def height_of(size: int) -> int:
    """Levels below the root of a block in a tree whose level has ``size`` nodes."""
    height = 0
    while size > 1 and height < HEIGHT:
        size, height = -(-size // FANOUT), height + 1
    return height


def _run(nodes: bytes | bytearray, at: list[int], start: int, count: int) -> list[bytes]:
    return [bytes(nodes[DIGEST * a : DIGEST * (a + 1)]) for a in at[start : min(start + FANOUT, count)]]


def parent_of(run: list[bytes]) -> bytes:
    """Digest of a run of sibling digests, taken as hex text."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def subtree(leaves: list[bytes], height: int) -> bytes:
    """Digests of a block in van Emde Boas order; slots of absent nodes are zero."""
    places = [a.tolist() for a in addresses(height)]
    nodes = bytearray(DIGEST * slots(height))
    for a, leaf in zip(places[height], leaves):
        nodes[DIGEST * a : DIGEST * (a + 1)] = leaf
    count = len(leaves)
    for depth in range(height, 0, -1):
        for n, start in enumerate(range(0, count, FANOUT)):
            a = places[depth - 1][n]
            nodes[DIGEST * a : DIGEST * (a + 1)] = parent_of(_run(nodes, places[depth], start, count))
        count = -(-count // FANOUT)
    return bytes(nodes)


def block_paths(nodes: bytes, leaves: int, height: int, above: bytes) -> list[bytes]:
    """Path of every leaf of a block: per level, from the leaf up, a byte for place and length of the run, then the siblings."""
    places = [a.tolist() for a in addresses(height)]
    counts = [leaves]
    for _ in range(height):
        counts.append(-(-counts[-1] // FANOUT))
    paths = [above]
    for depth in range(1, height + 1):
        count = counts[height - depth]
        made = []
        for start in range(0, count, FANOUT):
            run = _run(nodes, places[depth], start, count)
            for k in range(len(run)):
                made.append(bytes([k * (FANOUT + 1) + len(run)]) + b"".join(run[:k] + run[k + 1 :]) + paths[start // FANOUT])
        paths = made
    return paths


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """Root that a leaf leads to along a path, and the concatenated siblings."""
    siblings, at = [], 0
    while at < len(path):
        place, length = divmod(path[at], FANOUT + 1)
        run = [path[at + 1 + DIGEST * k : at + 1 + DIGEST * (k + 1)] for k in range(length - 1)]
        siblings += run
        leaf = parent_of([*run[:place], leaf, *run[place:]])
        at += 1 + DIGEST * (length - 1)
    return leaf, b"".join(siblings)


def leaf_digest(columns: dict[str, Column]) -> Column:
    """sha256 of the fields in order: ``-`` for null, else UTF-8 length, colon, value."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


@dataclass
class Manifest:
    """Blocks of all trees by tier, and of the tree over their roots.

    A tier has one row per block: ``tree, block, size`` (nodes of the tree at this level), ``nodes``
    (digests in van Emde Boas order), ``root``, ``loads`` (what its leaves carry).
    """

    tiers: list[DataFrame]
    top: list[DataFrame]

    def roots(self) -> DataFrame:
        """``tree, subroot, root, path``: path from a tree's root to the root of all."""
        whole = self.top[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"), F.col("root").alias("whole"), F.lit(None).cast("binary").alias("subroot"))
        found = _descend(self.top, whole)
        return found.select(F.col("load.tree").alias("tree"), F.col("digest").alias("subroot"), F.col("whole").alias("root"), "path")

    def proofs(self) -> DataFrame:
        """``load, digest, path, subroot, whole`` of every leaf."""
        tops = self.roots().select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("root").alias("whole"), "subroot")
        return _descend(self.tiers, tops)


def build_tiers(leaves: DataFrame) -> list[DataFrame]:
    """Tiers over ``tree, pos, size, digest, load``; positions are dense from 0, ``size`` is that of the tree."""
    tiers, level = [], leaves
    while True:
        blocks = reliable_checkpoint(_blocks(level))
        tiers.append(blocks)
        if (blocks.agg(F.max("size")).first()[0] or 0) <= LEAVES:
            return tiers
        level = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / LEAVES).alias("size"), F.col("root").alias("digest"), F.struct(F.lit(0).alias("none")).alias("load"))


def _blocks(level: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "digest", "load")))  # at most LEAVES
    grouped = level.groupBy("tree", F.floor(F.col("pos") / LEAVES).alias("block")).agg(F.first("size").alias("size"), rows.alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = [], []
            for size, digests in zip(batch.column(2).to_pylist(), batch.column(3)):
                height = height_of(size)
                nodes.append(subtree(digests.values.field("digest").to_pylist(), height))
                roots.append(nodes[-1][:DIGEST])  # the root is always the first slot
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), batch.column(4)], ["tree", "block", "size", "nodes", "root", "loads"])

    shaped = grouped.select("tree", "block", "size", F.transform("rows", lambda r: F.struct(r["digest"].alias("digest"))).alias("rows"), F.transform("rows", lambda r: r["load"]).alias("loads"))
    schema = T.StructType([*shaped.schema.fields[:3], T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType()), shaped.schema["loads"]])
    return shaped.mapInArrow(run, schema)


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Carry paths (``tree, block, path, whole, subroot``) from the last tier's blocks down to the first tier's leaves."""
    for k in range(len(tiers) - 1, -1, -1):
        found = tiers[k].select("tree", "block", "size", "nodes", "loads").join(above, ["tree", "block"])
        above = found.mapInArrow(_leaves_of, T.StructType([found.schema["tree"], T.StructField("pos", T.LongType()), T.StructField("load", found.schema["loads"].dataType.elementType), T.StructField("digest", T.BinaryType()), *(T.StructField(c, T.BinaryType()) for c in ("path", "whole", "subroot"))]))
        if k:
            above = reliable_checkpoint(above.select("tree", F.col("pos").alias("block"), "path", "whole", "subroot"))
    return above


#: Leaves whose paths leave a task at a time.
EMIT = 20_000


def _leaves_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, EMIT // LEAVES)):
            part = batch.slice(start, max(1, EMIT // LEAVES))
            block, size, loads = part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(4)
            counts = loads.value_lengths().to_pylist()
            of = pa.array(np.repeat(np.arange(part.num_rows), counts))
            digests, paths, positions = [], [], []
            for b, n, count, nodes, above in zip(block, size, counts, part.column(3).to_pylist(), part.column(5).to_pylist()):
                height = height_of(n)
                digests += [nodes[DIGEST * a : DIGEST * (a + 1)] for a in addresses(height)[height][:count].tolist()]
                paths += block_paths(nodes, count, height, above)
                positions += range(b * LEAVES, b * LEAVES + count)
            arrays = [part.column(0).take(of), pa.array(positions, pa.int64()), loads.flatten(), pa.array(digests, pa.binary()), pa.array(paths, pa.binary()), part.column(6).take(of), part.column(7).take(of)]
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "pos", "load", "digest", "path", "whole", "subroot"])


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "source", seen: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table: one tree per value of ``tree_col``, ordered null first, then by UTF-8 bytes.

    Leaves digest the named columns, in order; within a tree they ascend by id (null first), equal ids by
    digest. Any other column is left behind, whatever its name. A leaf carries ``id`` and ``seen``: the
    digest of the row as found later, with the column expressions ``seen`` in place of the columns named (null if
    none is given). Null and empty texts differ (``-`` and ``0:``). Repeated rows are leaves of their own.
    An empty table has no block.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    later = F.unhex(leaf_digest(own | seen)) if seen else F.lit(None).cast("binary")
    tree = F.when(F.col(f"`{tree_col}`").isNull(), "").otherwise(F.concat(F.lit("+"), F.col(f"`{tree_col}`").cast("string")))
    rows = reliable_checkpoint(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.unhex(leaf_digest(own)).alias("digest"), later.alias("seen"), F.monotonically_increasing_id().alias("row")))
    tiers = build_tiers(sorted_positions(rows, "tree", ["id", "digest", "row"]).select("tree", "pos", "size", "digest", F.struct("id", "seen").alias("load")))
    subroots = tiers[-1].select(F.lit("").alias("all"), "tree", F.col("root").alias("digest"))
    placed = sorted_positions(subroots, "all", ["tree"]).select(F.col("all").alias("tree"), "pos", "size", "digest", F.struct("tree").alias("load"))
    return Manifest(tiers, build_tiers(placed))


def audit(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``, all digests as lowercase hex.

    ``proof_sha256`` digests the siblings on the path, as hex text; ``folded_root`` is the root that the
    leaf as seen later, or else as stored, leads to along the stored path.
    """
    proofs = manifest.proofs()
    proofs = proofs.select(F.col("load.id").alias("id"), F.col("load.seen").alias("seen"), "digest", "path", "subroot", "whole")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, digest, path, subroot, whole = (batch.column(k).to_pylist() for k in range(1, 6))
            proof, folded = [], []
            for s, d, p in zip(seen, digest, path):
                root, siblings = fold(d if s is None else s, p)
                proof.append(hashlib.sha256(siblings.hex().encode()).hexdigest())
                folded.append(root)
            texts = [[x.hex() for x in column] for column in (digest, subroot, whole, folded)]
            arrays = [batch.column(0), *(pa.array(c, pa.string()) for c in (texts[0], texts[1], texts[2], proof, texts[3])), pa.array([a == b for a, b in zip(folded, whole)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = T.StructType([proofs.schema["id"], *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])
    return proofs.mapInArrow(run, schema)
