"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import re

import pytest
import xxhash

import corpus_pipeline
from tidewell.llm.common import documents, table
from tidewell.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.01"


def test_pipeline_equals_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    docs = sorted((r["doc_id"], r["text"]) for r in documents(spark, SF).collect())
    docs = [(i, t) for i, t in docs if re.search(r"[^\W\d_]", t or "")]  # language ID rejects letterless texts; all others here are in learned languages
    seen, kept = set(), []
    for i, t in docs:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if norm not in seen:
            seen.add(norm)
            kept.append((i, t))
    prints = []
    for _, t in kept:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in (list(zip(w, w[1:], w[2:])) or [w])]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    kept = [d for k, d in enumerate(kept) if root[k] == k]
    words = lambda t: " " + " ".join(re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower())) + " "
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in kept if not any(x in words(t) for x in items)}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
