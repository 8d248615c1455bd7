"""Operators that read one text at a time, against libraries, brute force or held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import guesses, language, personal
from tidewell.llm.bpe import Encoder, Vocabulary, decode_ids, encode_documents
from tidewell.llm.common import documents, table
from tidewell.llm.decontaminate import contamination, decontaminated, tiling
from tidewell.llm.quality import quality_scores
from tidewell.llm.queries import vocabulary_path
from tidewell.llm.secrets import scan_secrets, secret_spans
from tidewell.llm.tagger import Tagger
from tidewell.llm.tokens import runs

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def test_runs_end_at_row_bounds():
    mask = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], bool)
    starts, ends = runs(mask, np.array([0, 1, 5, 5, 9]))
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 1), (1, 2), (3, 5), (5, 6), (8, 9)]


# BPE


def bpe_cases():
    rng = random.Random(8)
    plain = ["", "aaa aaaa aaaaaaaaaaa", "ΣΑΣ Ὀδυσσεύς", "<|endoftext|> x<|startoftext|>y", "it's I'LL 12345 ½ ²", "é İstanbul ǅ", "日本語 テスト　あ", "a\x1cb\x85c", "🙂🙂!!**", "\x00 a", "Ǆ ﬁ ß ẞ", "<|endoftext|", "don''t 's's", "x" * 5000]
    return plain + ["".join(rng.choice("aAbé '1.\n<|>tTheβ") for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_bpe_equals_the_library_and_survives_forgetting(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    texts = bpe_cases() + [r["text"] for r in documents(spark, SMALL).collect()]
    encoder, vocab = Encoder(Vocabulary(vocabulary_path()), memo=50), Vocabulary(vocabulary_path())
    made = list(itertools.chain.from_iterable(encoder.encode(texts[k : k + 40]) for k in range(0, len(texts), 40)))
    for text, (ids, decoded), want in zip(texts, made, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert decoded == library.decode(want.ids, skip_special_tokens=False) == decode_ids(want.ids, vocab)


def test_bpe_query_columns(spark):
    rows = encode_documents(spark.createDataFrame([(1, "The sea"), (2, None)], SCHEMA), vocabulary_path(), with_ids=True).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [2, 0]
    assert rows[0]["ids_sha256"] == hashlib.sha256(np.array(rows[0]["ids"], "<u4").tobytes()).hexdigest()
    assert rows[1]["ids_sha256"] == rows[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


# Secrets


def test_guess_cost_is_the_minimum_over_all_cuts():
    def brute(value):
        found, per = guesses.spans(value), math.log10(max(guesses.alphabet(value), 2))
        best = math.inf
        for cut in itertools.product([0, 1], repeat=len(value) - 1):
            ends = [k + 1 for k, c in enumerate(cut) if c] + [len(value)]
            cost, start = 0.0, 0
            for end in ends:
                cost += min([(end - start) * per, *(c for s, c, _ in found.get(end, ()) if s == start)])
                start = end
            best = min(best, cost + math.lgamma(len(ends) + 1) / math.log(10))
        return best

    for value in ("password", "Passw0rd1", "qwertyuiop", "abcabcabc", "20240131x", "zx81Kq", "aaaaaaaa", "hunter2"):
        assert guesses.guess_cost(value) == pytest.approx(brute(value)), value
    assert guesses.guess_cost("") == 0
    assert guesses.guess_cost("changeme123") < 8 < guesses.guess_cost("x9Kf2LqP0zRt")


def secrets_brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_spans(spark):
    rng = random.Random(5)
    texts = [r["text"] for r in documents(spark, SMALL).collect()]
    pieces = ["password", "Token", "api_key", "APIKEY", "ſecret", "secret", "=", ": ", '"', " ", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "short", "é", "pwd=", "hunter2-Zq81kL"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text in texts:
        assert [s for s in secret_spans(text) if s[1] < 3] == secrets_brute(text), text
    added = lambda t: [t[a:b] for a, k, b in secret_spans(t) if k == 3]
    assert added("pwd = Zq81kL-x9Kf2") == ["Zq81kL-x9Kf2"]
    assert added("pwd = password1234 and passphrase: changeme2024") == []
    row = scan_secrets(spark.createDataFrame([(1, 'é token = "839756d1d951091d9155cd2a"'), (2, None)], SCHEMA)).orderBy("doc_id").collect()
    assert (row[0]["n_assign"], row[0]["n_hex"], row[1]["spans"]) == (1, 1, "")
    assert row[0]["spans"] == "assign:2:35,hex:11:35,guess:11:35"


# Personal data


def personal_brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or personal.luhn(digits)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_of_personal_data(spark):
    rng = random.Random(6)
    texts = [r["text"] for r in documents(spark, SMALL).collect()]
    texts += ["".join(rng.choice("a@@.1234+- ().%4é") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["9" * 3000 + ".1.2.3", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "4111 1111 1111 1111", "x" * 3000]
    for text in texts:
        assert personal.base_spans(text) == personal_brute(text), text


def test_tagger_gradients_and_viterbi():
    tagger, rng = Tagger.fresh(6, 3, 4, 5), np.random.default_rng(0)
    codes, mask = rng.integers(1, 6, (4, 6)), np.ones((4, 6), bool)
    mask[1, 4:] = mask[2, 2:] = False
    codes[~mask] = 0
    truth = np.where(mask, rng.integers(0, 3, (4, 6)), 0)
    tagger.weights["t"] = rng.normal(0, 1, (3, 3))

    def score(s, move, path):
        return s[0, path[0]] + sum(move[path[k - 1], path[k]] + s[k, path[k]] for k in range(1, len(path)))

    def loss():
        total, scores = 0.0, tagger.emissions(codes, mask)
        for s, m, y in zip(scores, mask, truth):
            n = int(m.sum())
            every = [score(s, tagger.weights["t"], p) for p in itertools.product(range(3), repeat=n)]
            total += np.log(np.exp(every).sum()) - score(s, tagger.weights["t"], y[:n])
        return total / 4

    grads = tagger.gradients(codes, mask, truth)
    for name, weight in tagger.weights.items():
        at = tuple(rng.integers(0, n) for n in weight.shape)
        old, sides = weight[at], []
        for step in (1e-5, -1e-5):
            weight[at] = old + step
            sides.append(loss())
        weight[at] = old
        assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6), name
    scores = tagger.emissions(codes, mask)
    for s, m, got in zip(scores, mask, tagger.decode(scores, mask)):
        n = int(m.sum())
        assert tuple(got[:n]) == max(itertools.product(range(3), repeat=n), key=lambda p: score(s, tagger.weights["t"], p))


def test_personal_model_finds_base_spans_and_further_forms(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    tagger = personal.learn(docs)
    codes = personal._code_table()
    held = [r["text"] for r in documents(spark, "/root/testdata/sf0.1").filter(F.col("text").rlike("[0-9@]")).orderBy("doc_id").limit(150).collect()]
    found = wanted = 0
    for text in held:
        starts = personal.window_starts(text)
        model = personal.reconcile(text, [], zip(starts, personal.decode_windows(tagger, [text[a : a + 64] for a in starts], codes)))
        wanted += len(personal.base_spans(text))
        found += len({(a, k - 4, b) for a, k, b in model} & set(personal.base_spans(text)))
    assert found >= 0.8 * wanted > 0
    rows = personal.scan_personal(docs, tagger).collect()
    clean = [r for r in rows if r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0]
    assert sum(r["n_model"] for r in clean) <= 0.01 * len(clean)
    assert all("model_" in r["spans"] for r in rows if r["n_model"])


# Language


def test_phrases_equal_greedy_cross_parsing():
    rng = random.Random(9)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    model = language.model_of({"x": [sample]})
    codes = language.code_table(model.letters)
    known = " ".join(sample.split())
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdA ") for _ in range(rng.randint(0, 60))).split())
        made, bounds = language.codes_of([text], codes)
        low, want = text.lower(), 0
        at = 0
        while at < len(low):
            end = at + 1
            while end <= len(low) and low[at:end] in known:
                end += 1
            at = max(end - 1, at + 1)
            want += 1
        assert language.phrases(model, made, bounds)[0, 0] == want, text


def test_language_of_held_out_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


# Quality


def test_quality_of_held_out_documents(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert np.mean([(r["score"] - r["quality"]) ** 2 for r in got]) < 0.03


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_scores(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(k, 1) for k in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality_scores(docs, one).collect())


# Decontamination


def tiling_brute(doc, item, least):
    doc, item = list(doc), list(item)
    least = min(least, len(item))
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n > best[2]:
                    best = (d, i, n)
        if best[2] < least:
            break
        d, i, n = best
        free_d[d : d + n] = free_i[i : i + n] = [False] * n
        tiles.append(best)
    return tiles


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(10)
    for _ in range(300):
        doc, item = rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        assert sum(t[2] for t in tiling(doc, item, 3)) == sum(t[2] for t in tiling_brute(doc, item, 3))


def test_contamination_of_whole_reordered_and_short_items(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, "alpha beta"), (3, None), (4, "!!")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"before {item.upper()}, after"), (2, "x seven eight nine ten eleven twelve y one two three four five six z"), (3, "one two three four five"), (4, "so Alpha, BETA."), (5, None), (6, "clean text")], SCHEMA
    )
    for block_words in (500_000, 1):
        got = {r["doc_id"]: r for r in contamination(docs, bench, block_words=block_words).collect()}
        assert [got[k]["contaminated"] for k in range(1, 7)] == [True, True, False, True, False, False]
        assert (got[2]["coverage"], got[2]["n_tiles"], got[4]["item_id"]) == (1.0, 2, 2)
    assert sorted(r["doc_id"] for r in decontaminated(docs, bench).collect()) == [3, 5, 6]


def test_contamination_matches_text_search(spark):
    docs, bench = documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "benchmark")
    words = lambda t: " " + " ".join(re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower())) + " "
    items = [words(r["text"]) for r in bench.collect()]
    planted = {r["doc_id"] for r in docs.collect() if any(i in words(r["text"]) for i in items)}
    got = {r["doc_id"] for r in contamination(docs, bench).filter("contaminated").collect()}
    assert planted and planted <= got and len(got - planted) <= 0.01 * docs.count()


def test_arrow_offsets_of_sliced_columns():
    from tidewell.llm.common import text_bytes

    data, bounds = text_bytes(pa.array(["ab", None, "é", "x"]).slice(1, 3))
    assert (bytes(data), bounds.tolist()) == ("éx".encode(), [0, 0, 2, 3])
