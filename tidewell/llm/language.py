"""Language identification by cross-parsing entropy.

Per language, a suffix automaton holds all substrings of a bounded sample of labelled text. A document
is cut, from the left, into the longest phrases that the automaton knows; a letter it does not know is
a phrase. Phrases times log2 of the sample's length, per letter, estimate the cross entropy in bits;
the language that needs the fewest bits wins. Every letter of a sample has a code of its own. Automata
are built once, from the sample, and sent to the tasks as sparse arrays (sorted keys of state and code)
whose size is bound by the sample, whatever the alphabet; a task parses thousands of blocks of text in
lockstep. A phrase ends at the end of a block of ``BLOCK`` letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import SMALL_SLICE, crc_mod, slices, texts_of

#: The sample of a language: this many rows at most (those with the smallest hash of their id), a
#: passage of at most PASSAGE letters at a hashed place of each, SAMPLE letters in all.
SAMPLE_ROWS = 60
PASSAGE = 4000
SAMPLE = 40_000
#: Codes of blanks and of letters that no sample holds; each letter of the samples has its own.
SPACE, OTHER = 0, 1
BLOCK = 1024
#: Moves (states times letters of a language) up to which an automaton is a full table; larger ones are sorted keys.
DENSE = 8_000_000


@dataclass
class Automaton:
    local: np.ndarray  # code in the model -> code in this language, OTHER if its sample does not hold the letter
    root: np.ndarray  # code in this language -> state
    table: np.ndarray | None  # state * width + code -> state, or -1
    keys: np.ndarray | None  # without a table: sorted state * width + code
    targets: np.ndarray | None  # and their states

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        if self.table is not None:
            return self.table.take(state * np.int32(len(self.root)) + code)
        key = state.astype(np.int64) * len(self.root) + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys.take(at) == key, self.targets.take(at), np.int32(-1))


@dataclass
class Model:
    languages: list[str]
    letters: str
    automata: list[Automaton]  # by language
    bits: list[float]  # cost of a phrase


#: Code points from here on are no letters.
POINTS = 0x40000


def code_table(letters: str) -> np.ndarray:
    """Code of each code point below POINTS."""
    number = {c: k + 2 for k, c in enumerate(letters)}
    table = np.zeros(POINTS, np.min_scalar_type(len(letters) + 1))
    for point in range(POINTS):
        low = chr(point).lower()
        if low.isalpha():
            table[point] = number.get(low, OTHER)
    return table


def codes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, runs of other characters as one blank, and the n+1 offsets of the texts."""
    texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    codes = table[np.minimum(points, POINTS - 1)]
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    if len(keep):
        first = bounds[:-1][bounds[:-1] < len(codes)]
        keep[first] = codes[first] != SPACE
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def automaton(codes: np.ndarray, total: int) -> Automaton:
    """Suffix automaton of a sequence of codes below ``total``; the last state is that of an unknown letter."""
    own = np.setdiff1d(codes, [SPACE, OTHER])
    local = np.full(total, OTHER, np.int32)
    local[SPACE] = SPACE
    local[own] = np.arange(2, len(own) + 2)
    codes, width = local[codes], len(own) + 2
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    unknown = len(moves)
    root = np.full(width, unknown, np.int32)
    root[list(moves[0])] = list(moves[0].values())
    moves[0] = dict(enumerate(root.tolist()))
    keys = np.array([state * width + c for state, out in enumerate(moves) for c in sorted(out)], np.int64)
    targets = np.array([out[c] for out in moves for c in sorted(out)], np.int32)
    if (unknown + 1) * width > DENSE:
        return Automaton(local, root, None, keys, targets)
    table = np.full((unknown + 1) * width, -1, np.int32)
    table[keys] = targets
    return Automaton(local, root, table, None, None)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2) -> Model:
    """Automata from rows with a language whose crc32(id) mod ``modulus`` is not ``held_out``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held_out))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = [r[0] for r in rows.select("lang", "doc_id").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE_ROWS).select("doc_id").distinct().collect()]
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    sample = rows.filter(F.col("doc_id").isin(chosen)).select("lang", F.xxhash64("doc_id").alias("h"), F.expr("text").substr(start, F.lit(PASSAGE)).alias("text")).collect() if chosen else []
    by: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
        by.setdefault(row["lang"], []).append(row["text"])
    return model_of(by)


def model_of(by: dict[str, list[str]]) -> Model:
    """Automata of the given texts by language; a language without a letter is left out."""
    found = {c.lower() for texts in by.values() for t in texts for c in set(unicodedata.normalize("NFC", t))}
    letters = "".join(sorted(c for c in found if len(c) == 1 and c.isalpha()))
    table = code_table(letters)
    model = Model([], letters, [], [])
    for language in sorted(by):
        codes, _ = codes_of([" ".join(by[language])], table)
        codes = codes[:SAMPLE]
        if (codes != SPACE).any():
            model.languages.append(language)
            model.automata.append(automaton(codes, len(letters) + 2))
            model.bits.append(float(np.log2(max(len(codes), 2))))
    return model


def phrases(model: Model, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) by language (columns)."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = bounds[:-1][text] + number * BLOCK
    length = np.minimum(bounds[1:][text] - start, BLOCK)
    order = np.argsort(-length, kind="stable")
    start, length, text = start[order], length[order], text[order]
    longest = int(length[0]) if len(length) else 0
    active = len(length) - np.searchsorted(length[::-1], np.arange(longest), "right")
    out = np.zeros((len(sizes), len(model.languages)), np.int64)
    if not longest:
        return out
    grid = codes[np.minimum(start[None, :] + np.arange(longest)[:, None], len(codes) - 1)].astype(np.int32)
    for k, known in enumerate(model.automata):
        state = np.zeros(len(start), np.int32)
        count = np.zeros(len(start), np.int32)
        for t, n in enumerate(active.tolist()):
            code = known.local.take(grid[t, :n])
            to = known.step(state[:n], code)
            miss = to < 0
            count[:n] += miss
            np.copyto(to, known.root.take(code), where=miss)
            state[:n] = to
        out[:, k] = np.bincount(text, count + 1, len(sizes)).astype(np.int64)  # and the phrase that the end cuts off
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2, with_row: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, bits_per_letter``; if asked, ``_row``, a struct of the input row.

    Whole texts are parsed. ``und`` with score 0 is given to null, empty and letterless texts, and to all
    if nothing was learned. ``score`` is the runner-up's share of the bits of the best two (1 with a
    single language); ties go to the first language by name. Repeated rows give repeated results, other
    columns are ignored, a null id is not held out.
    """
    doc_id, text = F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    # with the whole row, its own text is read, so that no text is sent twice
    carried = F.struct(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns]).alias("_row") if with_row else text
    rows = docs.select(doc_id, (crc_mod(F.col(f"`{id_col}`"), modulus) == held_out).alias("held_out"), carried)
    at = docs.columns.index(text_col) if with_row else 0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = code_table(known.letters)
        texts = (pa.RecordBatch.from_arrays([*b.columns, b.column(2).flatten()[at] if with_row else b.column(2)], ["doc_id", "held_out", "_row", "text"]) for b in batches)
        for batch in slices(texts, limit=SMALL_SLICE):
            best, score, rate = judge(known, texts_of(batch.column(3)), table)
            made = {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(best, pa.string()), "score": pa.array(score), "bits_per_letter": pa.array(rate)}
            yield pa.RecordBatch.from_pydict(made | ({"_row": batch.column(2)} if with_row else {}))

    schema = T.StructType([rows.schema["doc_id"]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("bits_per_letter", "double")
    return rows.mapInArrow(run, schema.add(rows.schema["_row"]) if with_row else schema)


def judge(model: Model, texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per letter of each text."""
    codes, bounds = codes_of(texts, table)
    lettered = np.diff(np.concatenate(([0], np.cumsum(codes != SPACE)))[bounds]) > 0
    n = len(texts)
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n)
    bits = phrases(model, codes, bounds) * np.array(model.bits) / np.maximum(np.diff(bounds), 1)[:, None]
    best = np.argmin(bits, axis=1)
    least = bits[np.arange(n), best]
    if len(model.languages) > 1:
        second = np.partition(bits, 1, axis=1)[:, 1]
        score = second / np.maximum(least + second, 1e-9)
    else:
        score = np.ones(n)
    names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
    return names, np.where(lettered, score, 0.0), np.where(lettered, least, 0.0)
