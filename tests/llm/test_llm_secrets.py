"""Secret scan: bounded guess costs against the unbounded ones, words from the corpus, wider context."""

import random
import time

import pytest

from tidewell.llm import guesses
from tidewell.llm.secrets import common_words, scan_secrets, secret_spans

DDL = "doc_id LONG, text STRING"


def values(text, **kw):
    return [text[a:b] for a, k, b in secret_spans(text, **kw) if k == 3]


def test_bounded_cost_is_exact_below_its_bound():
    rng = random.Random(3)
    parts = ["password", "abc", "qwerty", "2024-01-31", "aaaa", "x", "9", "Zq", "-", "horse", "İ", " "]
    for _ in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        whole = guesses.guess_cost(value)
        for enough in (3.0, 6.0, 10.0, 15.0):
            assert guesses.guess_cost(value, enough) == pytest.approx(min(whole, enough)), value


def test_any_length():
    rng = random.Random(4)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    start = time.time()
    assert guesses.guess_cost(noise, 10.0) == 10.0
    assert guesses.guess_cost("a" * 1_000_000, 10.0) < 8
    assert guesses.guess_cost("ab12" * 100_000, 10.0) == 10.0 or guesses.guess_cost("ab12" * 100_000, 20.0) < 13
    assert time.time() - start < 20
    # a repeated word stays cheap however often it stands
    assert guesses.guess_cost("xyxy" * 50) == pytest.approx(guesses.guess_cost("xyxy" * 50, 50.0))


def test_context_of_a_value():
    assert values("pwd      =      Zq81kL-x9Tq7") == ["Zq81kL-x9Tq7"]
    assert values('token: "correct horse battery staple zebra"') == ["correct horse battery staple zebra"]
    assert values("secret := 'Zq81 kL-x9 Tq7'; next") == ["Zq81 kL-x9 Tq7"]
    assert values('token: "never closed Zq81kL-x9Tq7') == []
    assert values('token: "Zq81kL-x9Tq7 never closed') == ["Zq81kL-x9Tq7"]
    assert values("password:\nZq81kL-x9Tq7") == []
    assert values("x9Kf2LqP0zRt9") == [] and values("password: hunter") == []
    assert values("password: hunter2") == ["hunter2"]  # 36 letters and digits to the seventh


def test_words_come_from_the_corpus(spark):
    plain = ["the strawberry administrator met an architecture student", "architecture and strawberry jam for the administrator"]
    hidden = ["token = zqkxwvjfhgpd", "token = zqkxwvjfhgpd again", 'secret: "zqkxwvjfhgpd mnbtrvqxzkjw"']
    docs = spark.createDataFrame(list(enumerate([*plain, *hidden, None, "", "secret: strawberry, bearer: architecture; password: administrator"])), DDL)
    ranks = common_words(docs)
    assert {"strawberry", "architecture", "administrator"} <= set(ranks) and not {"zqkxwvjfhgpd", "student", "an"} & set(ranks)
    assert ranks["password"] == 1 and min(ranks["strawberry"], ranks["administrator"]) > len(guesses.WORDS) - 5
    got = {r["doc_id"]: (r["n_guess"], r["spans"]) for r in scan_secrets(docs, ranks=ranks).collect()}
    # a base span of 12 characters stays whatever its words
    assert got[7] == (0, "assign:42:65") and got[5] == got[6] == (0, "")
    assert got[2][1] == "assign:0:20,guess:8:20" and got[4][1] == "assign:0:21,guess:9:34"
    assert values(docs.collect()[7]["text"]) != []
    # a class of equal frequency is taken whole or not at all
    assert set(common_words(docs, most=1)) == set(guesses.RANKS)
    assert set(common_words(docs.limit(0))) == set(guesses.RANKS)
