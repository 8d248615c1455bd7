"""The manifest against a plain tree, its layout, tampering, and awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import merkle
from tidewell.llm.common import documents
from tidewell.llm.queries import op11_merkle_manifest

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields) -> str:
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(level: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """Root of a list of digests, and the (place, run) of each leaf on each level."""
    steps = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(at):
            steps[k].append((p % 3, level[p - p % 3 : p - p % 3 + 3]))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], steps


def plain(rows: list, breaks: bool = True) -> list[tuple]:
    """All result rows, from a tree in memory."""
    trees = {}
    for r in rows:
        seen = r["text"]
        if breaks and seen is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            seen = seen.replace("\n", "")
        digests = [leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], t) for t in (r["text"], seen)]
        trees.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, digests[0]), r["doc_id"], *digests))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: climb([d for _, _, d, _ in sorted(trees[s], key=lambda x: x[0])]) for s in order}
    root, tops = climb([found[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (_, doc_id, own, seen), steps in zip(sorted(trees[s], key=lambda x: x[0]), found[s][1]):
            siblings, folded = "", seen
            for place, run in [*steps, *top]:
                siblings += "".join(run[:place] + run[place + 1 :])
                folded = sha("".join([*run[:place], folded, *run[place + 1 :]]))
            out.append((doc_id, own, found[s][0], root, sha(siblings), folded, folded == root))
    return out


def result(df) -> list[tuple]:
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_equals_a_plain_tree(spark):
    folder = "/root/testdata/sf0.01"
    got = result(op11_merkle_manifest(spark, folder))
    assert got == sorted(plain(documents(spark, folder).collect()), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("height", range(7))
def test_layout_uses_every_slot_once_and_keeps_subtrees_together(height):
    places = merkle.addresses(height)
    assert sorted(a for level in places for a in level.tolist()) == list(range(merkle.slots(height)))
    assert places[0][0] == 0
    if height:
        top = (height - 1) // 2
        low = merkle.slots(height - top - 1)
        for n, root in enumerate(places[top + 1].tolist()):  # a bottom tree is one run of slots
            own = [a for d in range(top + 1, height + 1) for a in places[d][n * 3 ** (d - top - 1) : (n + 1) * 3 ** (d - top - 1)].tolist()]
            assert sorted(own) == list(range(root, root + low))


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 8, 9, 10, 28, 728, 729])
def test_block_paths_lead_to_the_root(leaves):
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(leaves)]
    height = merkle.height_of(leaves)
    nodes = merkle.subtree(digests, height)
    root, steps = climb([d.hex() for d in digests])
    assert nodes[:32].hex() == root
    for k, path in enumerate(merkle.block_paths(nodes, leaves, height, b"")):
        folded, siblings = merkle.fold(digests[k], path)
        assert folded.hex() == root
        assert siblings.hex() == "".join("".join(run[:p] + run[p + 1 :]) for p, run in steps[k])


def test_many_tiers_and_many_trees(spark):
    one = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t\n"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("big").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    many = spark.range(2500, 3600).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), "id").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs = one.unionByName(many)
    without = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.merkle_manifest(docs, seen={"text": without})
    assert len(manifest.tiers) == 2 and len(manifest.top) == 2
    assert result(merkle.audit(manifest).withColumnRenamed("id", "doc_id")) == sorted(plain(docs.collect()), key=str)


def test_awkward_rows_and_none(spark):
    long = "line\n" * 300_000
    rows = [(1, long, "en", "a", 1), (2, None, None, None, None), (3, "", "fr", "", 0), (4, "ä\n", "fr", "ä", 4), (5, "same", "en", None, 3), (5, "same", "en", None, 3), (5, "other", "en", None, 3), (None, "no id", None, "x", 2), (None, None, None, None, None), (-7, "minus", "de", "+a", 5)]
    docs = spark.createDataFrame(rows, ROW)
    wide = docs.withColumns({c: F.lit("clash") for c in ("tree", "id", "digest", "seen", "row", "pos", "size", "load", "block", "_at", "path")})
    got = result(merkle.audit(merkle.merkle_manifest(wide)).withColumnRenamed("id", "doc_id"))
    assert got == sorted(plain(docs.collect(), breaks=False), key=str)
    assert all(r[-1] for r in got)
    assert merkle.audit(merkle.merkle_manifest(docs.limit(0))).count() == 0


def test_any_change_of_a_column_is_found(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for column, new in (("lang", F.lit("fr")), ("n_chars", F.lit(None).cast("long")), ("text", F.lit("b"))):
        found = merkle.audit(merkle.merkle_manifest(docs, seen={column: F.when(F.col("doc_id") == 17, new).otherwise(F.col(column))}))
        assert [r["id"] for r in found.filter("NOT verified").collect()] == [17]
