"""BPE encoding and decoding with a pair occurrence index.

A vocabulary file of the word-end kind (``</w>``) is read for its values only: merges, ids and added
tokens. All new pieces of a slice of texts are laid out as one array of symbols with links to the next
and previous symbol. An index maps each pair that has a rank to all its positions in that array. Active
ranks are taken in ascending order; a rank merges all its positions at once, and the pairs this creates
are appended to their lists. A merge can only create pairs of higher rank, since a symbol exists only
after the merge that makes it, so ascending order equals the order within each single word.

Pieces are split exactly as the file says: NFC, lower case, letter runs, single digits, other runs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.llm.common import id_text, slices, texts_of

# Fixed values of the tokenizer files: piece pattern, word end.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

SLICE = 4 << 20

#: Pieces kept in a task's memory at most; beyond, the memo starts anew.
MEMO_PIECES = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stays, the rest moves beyond 255."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a vocabulary file; ``path`` can be any place the executors can read."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names: list[str] = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for name, number in [*ids.items(), *self.added.items()]:
            self.names[number] = name
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.size = len(self.names)
        codes = left * self.size + right
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank_of = codes[order], order
        self.left, self.right, self.made = left, right, made
        self.inner = np.array([ids[s] for s in byte_symbols()], np.int64)
        self.final = np.array([ids[s + WORD_END] for s in byte_symbols()], np.int64)
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each pair code, or -1."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rank_of[at], -1)


def encode_pieces(pieces: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and the n+1 offsets of the pieces in it."""
    raw = [p.encode() for p in pieces]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    symbol = np.empty(total + 1, np.int64)
    symbol[:total] = vocab.inner[data]
    last = ends[sizes > 0] - 1
    symbol[last] = vocab.final[data[last]]
    symbol[total] = -1  # where links of a last symbol lead
    after = np.arange(1, total + 2)
    before = np.arange(-1, total)
    after[last] = total
    before[(ends - sizes)[sizes > 0]] = total
    after[total] = before[total] = total
    alive = np.ones(total + 1, bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Add pairs that start at the positions ``at`` to the index."""
        at = at[(at < total)]
        at = at[symbol[after[at]] >= 0]
        rank = vocab.ranks(symbol[at] * vocab.size + symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for group, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist()):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(group)

    enter(np.arange(total))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        a, b = vocab.left[r], vocab.right[r]
        at = at[alive[at] & (symbol[at] == a) & (symbol[after[at]] == b)]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # in a run of equal symbols every second pair, from the left
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - starts) % 2 == 0]
        gone = after[at]
        symbol[at] = vocab.made[r]
        alive[gone] = False
        after[at] = after[gone]
        before[after[gone]] = at
        before[total] = total
        enter(np.unique(np.concatenate((before[at], at))))
    alive[total] = False
    kept = np.flatnonzero(alive)
    return symbol[kept], np.searchsorted(kept, np.concatenate(([0], ends)))


class Encoder:
    """Encodes texts in a task; remembers pieces it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary, memo: int = MEMO_PIECES):
        self.vocab, self.memo = vocab, memo
        self.find = regex.compile(PIECES).findall
        self.forget()

    def forget(self) -> None:
        self.packed: dict[str, bytes] = {}
        self.named: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def parts(self, text: str) -> list[str]:
        """Pieces of a text; an added token is one piece that starts with a blank."""
        if self.vocab.special is None or "<" not in text:
            return self.pieces(text)
        out: list[str] = []
        for part in self.vocab.special.split(text):
            out += [" " + part] if part in self.vocab.added else self.pieces(part)
        return out

    def learn(self, fresh: list[str]) -> None:
        plain = [p for p in fresh if p[0] != " "]
        ids, cuts = encode_pieces(plain, self.vocab)
        packed, names = ids.astype("<u4").tobytes(), self.vocab.names
        flat, bounds = ids.tolist(), cuts.tolist()
        for k, p in enumerate(plain):
            lo, hi = bounds[k], bounds[k + 1]
            self.packed[p] = packed[4 * lo : 4 * hi]
            self.named[p] = " ".join([names[i] for i in flat[lo:hi]])
        for p in fresh:
            if p[0] == " ":
                self.packed[p], self.named[p] = self.vocab.added[p[1:]].to_bytes(4, "little"), p[1:]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids, little-endian unsigned 32-bit, and decoded text of each text."""
        if len(self.packed) > self.memo:
            self.forget()
        parts = [self.parts(t) for t in texts]
        fresh: set[str] = set()
        for ps in parts:
            fresh.update(set(ps).difference(self.packed))
        if fresh:
            self.learn(list(fresh))
        packed, named = self.packed.__getitem__, self.named.__getitem__
        for ps in parts:
            yield b"".join(map(packed, ps)), " ".join(map(named, ps))


def decode_ids(ids: Iterable[int], vocab: Vocabulary) -> str:
    """The file names no decoder, so decoding joins the tokens with blanks, special ones included."""
    return " ".join([vocab.names[i] for i in ids])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids``.

    Null and empty texts have no tokens. Repeated rows give repeated results; other columns are
    ignored. Texts are encoded whole, in slices of a few MB, with no shuffle. ``path`` names the
    vocabulary file, which must be readable on the executors.
    """
    wide = ", ids array<long>" if with_ids else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, limit=SLICE):
            encoder = encoder or Encoder(Vocabulary(path))
            made = list(encoder.encode(texts_of(batch.column(1))))
            columns = [
                batch.column(0),
                pa.array([len(ids) // 4 for ids, _ in made], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in made], pa.string()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in made], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(ids, "<u4").astype(np.int64) for ids, _ in made], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{wide}")
