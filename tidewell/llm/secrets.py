"""Secret scan: fixed patterns, and values in credential context that would be costly to guess.

The patterns give the base spans. The method adds ``guess`` spans: a value that follows a credential
word and a colon or equals sign is cut as cheaply as possible into words, dates, repeats, keyboard
walks and brute-force spans (``guesses.guess_cost``); if even that takes at least ``min_guesses`` (as a
power of ten) guesses, the value is a secret and not a placeholder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_text, reliable_checkpoint, slices, texts_of
from tidewell.llm.guesses import RANKS, WORDS, Ranks, guess_cost

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Credential context: a wider list of names, a separator amid any blanks of its line, and a value: up to the closing quote, or without blanks and quotes.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth(?:orization)?|bearer)"""
    r"""["']?[ \t]*(?::=|=>|[:=])[ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|["']?([^\s"'<>,;]+))""",
    re.ASCII | re.IGNORECASE,
)
MIN_GUESSES = 10.0
#: Bound on the words learned from the corpus, and on their letters.
MOST_WORDS = 20_000
LETTERS = (3, 32)


def common_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> Ranks:
    """The fixed words, then those found in most documents, counted over all of them, at most ``most``.

    A document counts a word once. Values in credential context are left out of the count, so a secret that many documents
    repeat does not become a word. Words of equal frequency class (a sixteenth of a doubling) are taken all or none, so the
    cut needs one bounded histogram and no sort of the vocabulary. Words of one document, of under three or over 32 letters
    are not words here. Null and empty texts have none; an empty table leaves the fixed words.
    """
    text = F.lower(F.regexp_replace(F.col(f"`{text_col}`").cast("string"), "(?i)" + CONTEXT.pattern, " "))
    words = docs.select(F.explode(F.array_distinct(F.split(text, r"[^\p{L}]+"))).alias("word")).filter(F.length("word").between(*LETTERS))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").withColumn("step", F.floor(F.log2("n") * 16))
    counts = reliable_checkpoint(counts)
    total, edge = 0, None
    for row in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True):
        total += row["words"]
        if total > most:
            break
        edge = row["step"]
    found = [] if edge is None else counts.filter(F.col("step") >= edge).collect()
    return Ranks([*WORDS, *(r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"])))])


def secret_spans(text: str, min_guesses: float = MIN_GUESSES, ranks: Ranks = RANKS) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans in code points, in order."""
    found: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        for m in CONTEXT.finditer(text):
            if guess_cost(m[m.lastindex], min_guesses, ranks) >= min_guesses:
                found.append((m.start(m.lastindex), 3, m.end(m.lastindex)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def written(spans: Iterable[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES, ranks: Ranks = RANKS) -> DataFrame:
    """One row per input row: counts per kind, digest of the base spans, and all spans.

    ``ranks`` are the words of the segmentation, such as those of ``common_words``; a bounded list that goes to every task.

    Null counts as empty: no spans, digest of the empty text. Repeated rows give repeated results,
    other columns are ignored, texts are read whole. No shuffle.
    """

    sent = docs.sparkSession.sparkContext.broadcast(list(ranks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ranks(sent.value)
        for batch in slices(batches):
            rows = [secret_spans(t, min_guesses, known) for t in texts_of(batch.column(1))]
            counts = [pa.array([sum(1 for s in r if s[1] == k) for r in rows], pa.int64()) for k in range(4)]
            base = [hashlib.sha256(written(s for s in r if s[1] < 3).encode()).hexdigest() for r in rows]
            spans = pa.array([written(r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts[:3], pa.array(base, pa.string()), spans, counts[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
