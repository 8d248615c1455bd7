"""Exact, near, byte-string and word-window duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import fuse
from tidewell.llm.common import documents
from tidewell.llm.components import components
from tidewell.llm.exact import exact_duplicates
from tidewell.llm.passages import substring_dedup
from tidewell.llm.simhash import fingerprint, links, majority, near_duplicates
from tidewell.llm.substrings import byte_dedup
from tidewell.llm.suffixes import repeated_starts, suffix_array

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def union_find(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fuse_filter_has_no_false_negatives_and_few_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n, np.int64).view(np.uint64)
        made = fuse.build(keys)
        assert made.may_contain(keys).all()
        others = rng.integers(0, 1 << 63, 20_000, np.int64).view(np.uint64)
        assert made.may_contain(others).mean() < 0.02


def exact_brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_duplicates(spark, batches):
    rows = [(i, random.Random(i).choice(["a b", "a  b", "a\tb ", "", None, "x", f"own {i}"])) for i in range(120)] + [(7, "a b"), (None, "x")]
    got = Counter(map(tuple, exact_duplicates(spark.createDataFrame(rows, SCHEMA), batches).collect()))
    assert got == exact_brute(rows)


def test_exact_duplicates_with_colliding_digests(spark):
    rows = [(i, f"text {i % 9}") for i in range(60)]
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    got = Counter(map(tuple, exact_duplicates(spark.createDataFrame(rows, SCHEMA), 3, digest=weak).collect()))
    assert got == exact_brute(rows)


def test_components_of_chain_cycle_and_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (5, 5), (None, 9)] + [(500, k) for k in range(501, 620)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {1: 1, 2: 1, 3: 1} | {k: 500 for k in range(500, 620)}


def test_majority_bits():
    rng = np.random.default_rng(2)
    for n in (1, 2, 254, 255, 256, 700):
        h = rng.integers(0, 1 << 63, n, np.int64).view(np.uint64)
        assert majority(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def test_links_connect_all_pairs_within_three_bits(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(centre)
            for _ in range(rng.randint(1, 4)):
                centre ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert any((fps[i] ^ fps[j]).bit_count() == 3 for i, j in pairs)
    at = {s[0]: k for k, s in enumerate(signed)}
    made = [(at[r["a"]], at[r["b"]]) for r in links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in made)
    assert union_find(len(fps), made) == union_find(len(fps), pairs)


def test_near_duplicates(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SMALL).collect()] + [(1001, None), (1002, ""), (1003, "One two"), (1004, "one\ttwo")]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    roots = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert len(got) == len(rows)
    for k, (doc_id, _) in enumerate(rows):
        assert (got[doc_id]["fingerprint"], got[doc_id]["component_id"]) == (f"{prints[k]:016x}", rows[roots[k]][0])
    assert fingerprint(b"") == 0


def test_suffix_array_and_repeats():
    rng = np.random.default_rng(4)
    for _ in range(300):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    for _ in range(60):
        strings = [rng.integers(0, 2, rng.integers(0, 30)) for _ in range(rng.integers(1, 6))]
        seen = Counter(tuple(x[k : k + 5]) for x in strings for k in range(len(x) - 4))
        want = {(n, k) for n, x in enumerate(strings) for k in range(len(x) - 4) if seen[tuple(x[k : k + 5])] > 1}
        assert set(zip(*(v.tolist() for v in repeated_starts(strings, 5)))) == want


def covered(symbols_of, rows, width):
    seen = Counter()
    split = [symbols_of(text or "") for _, text in rows]
    for s in split:
        seen.update(s[k : k + width] for k in range(len(s) - width + 1))
    for (doc_id, _), s in zip(rows, split):
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if seen[s[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        yield doc_id, s, gone


def noisy_rows(seed, alphabet, joiner):
    """Texts that share passages, with repeats inside a text, copies, and repeated rows."""
    rng = random.Random(seed)
    word = lambda n: [rng.choice(alphabet) for _ in range(n)]
    shared = [word(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(shared)[rng.randint(0, 4) :] if rng.random() < 0.6 else word(rng.randint(1, 30))
        rows.append((k, joiner.join(parts)))
    return rows + rows[:5] + [(k + 100, t) for k, t in rows[5:12]] + [(200, None), (201, ""), (202, joiner.join(["a"] * 90))]


@pytest.mark.parametrize("width", [6, 35])
def test_substring_dedup(spark, width):
    rows = noisy_rows(width, ["a", "b", "é", "dd", "The"], "  \n")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), width, with_text=True).collect())
    want = Counter()
    for doc_id, s, gone in covered(lambda t: tuple(t.split()), rows, width):
        kept = " ".join(w for w, g in zip(s, gone) if not g)
        want[doc_id, len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert got == want


@pytest.mark.parametrize(("width", "most"), [(40, 1000), (40, 1), (9, 2)])
def test_byte_dedup(spark, width, most):
    rows = noisy_rows(width + most, ["a", "b", "é", "ab"], "")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in byte_dedup(spark.createDataFrame(rows, SCHEMA), width, with_bytes=True, most=most).collect())
    want = Counter()
    for doc_id, s, gone in covered(lambda t: t.encode(), rows, width):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[doc_id, len(s), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
