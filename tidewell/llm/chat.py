r"""Chat formatting by token-level assembly.

Every segment of a conversation (a text, or a role the template does not know) is encoded by itself. The
turn's control strings are spliced in as reserved ids above the vocabulary, so no text can make one, and
the loss mask is the prefix sum of +1 where a learned text starts and -1 where it ends. Control strings
inside texts are escaped before encoding, so that the decoded string can be parsed too: a backslash goes
after their first character, and one more where there are some already (``</s>`` is ``<\/s>``,
``<\/s>`` is ``<\\/s>``), which is undone exactly.

Turns are dealt by sampled ranges of (conversation, turn), so a conversation with a third of the rows is
many partitions. The result has one row per part of a conversation: all of it, or, where a partition
or ``PART_TOKENS`` ends inside it, one of several consecutive parts, which end with a turn.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import reliable_checkpoint

#: Tokens after which a part ends, with the turn.
PART_TOKENS = 1 << 20
#: Characters encoded or decoded before rows leave a task.
EMIT_CHARS = 1 << 22


@dataclass(frozen=True)
class Template:
    """Control strings around a turn's text by role; ``other`` holds those of any other role: before it, after it, after the text."""

    frames: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TEXT]")
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [c for _, a, b in self.frames for c in (a, b)] + list(self.other)

    def pattern(self, escaped: bool) -> re.Pattern:
        by_first: dict[str, list[str]] = {}
        for c in self.controls():
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        slashes = r"\\(?=\\*" if escaped else r"(?=\\*"
        return re.compile("|".join(rf"(?<={re.escape(first)}){slashes}(?:{'|'.join(rests)}))" for first, rests in sorted(by_first.items())))


def escape(text: str, template: Template = Template()) -> str:
    return _patterns(template)[0].sub(lambda _: "\\", text)


def unescape(text: str, template: Template = Template()) -> str:
    return _patterns(template)[1].sub("", text)


@lru_cache(maxsize=8)
def _patterns(template: Template) -> tuple[re.Pattern, re.Pattern]:
    return template.pattern(False), template.pattern(True)


@dataclass
class Codec:
    """A byte-level vocabulary and, above its ids, one reserved id per control string."""

    encoding: object
    base: int
    template: Template
    opening: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.strings = self.template.controls()
        self.opening = {role: (self.base + 2 * k, self.base + 2 * k + 1) for k, (role, _, _) in enumerate(self.template.frames)}
        first = self.base + 2 * len(self.template.frames)
        self.other = (first, first + 1, first + 2)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(escape(text, self.template)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """As it stands in the output; several segments only if cut at reserved ids."""
        return self.encoding.decode_bytes(ids.tolist()).decode()

    def turn(self, role: str, text: str) -> tuple[list[np.ndarray], int]:
        """Pieces of a turn in order, and which of them is the text."""
        known = self.opening.get(role)
        if known:
            return [np.array(known[:1], np.int32), self.encode(text), np.array(known[1:], np.int32)], 1
        a, b, c = (np.array([x], np.int32) for x in self.other)
        return [a, self.encode(role), b, self.encode(text), c], 3

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str, int]]:
        """(role, text, characters as formatted) of each turn, read back from ids."""
        roles = {a: role for role, (a, _) in self.opening.items()}
        cuts = np.flatnonzero(ids >= self.base).tolist()
        k = 0
        while k < len(cuts):
            mark = int(ids[cuts[k]])
            marks, length = [mark], 0
            if mark in roles:
                role = roles[mark]
            else:
                raw = self.decode(ids[cuts[k] + 1 : cuts[k + 1]])
                role, length, k = unescape(raw, self.template), len(raw), k + 1
                marks.append(int(ids[cuts[k]]))
            raw = self.decode(ids[cuts[k] + 1 : cuts[k + 1]])
            marks.append(int(ids[cuts[k + 1]]))
            yield role, unescape(raw, self.template), length + len(raw) + sum(len(self.strings[m - self.base]) for m in marks)
            k += 2

    def formatted(self, ids: np.ndarray) -> str:
        """The whole output as a string."""
        out, start = [], 0
        for at in np.flatnonzero(ids >= self.base).tolist():
            out += [self.decode(ids[start:at]), self.strings[int(ids[at]) - self.base]]
            start = at + 1
        return "".join([*out, self.decode(ids[start:])])

    def under(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """The texts of the runs under a mask, unescaped."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            yield unescape(self.decode(ids[a:b]), self.template)


def assemble(pieces: list[np.ndarray], learned: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces spliced into one array of ids, and its loss mask: ``learned`` numbers the pieces under it."""
    ends = np.cumsum([len(p) for p in pieces]) if pieces else np.zeros(0, np.int64)
    ids = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    step = np.zeros(len(ids) + 1, np.int32)
    which = np.array(learned, np.int64)
    np.add.at(step, ends[which] - np.array([len(pieces[k]) for k in learned], np.int64), 1)
    np.add.at(step, ends[which], -1)
    return ids, np.cumsum(step[:-1]) > 0


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str, template: Template) -> Codec:
    """From a rank file: a base64 token and its rank on each line."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return Codec(tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1, template)


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The rank file, of bounded size: read by the driver if the path is local, else by Spark."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def format_conversations(rows: DataFrame, vocabulary: bytes, pattern: str, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per part of a conversation: ``conv_id, part, whole, n_turns, ids, loss``.

    Turns come in the order of ``turn`` (null first), equal ones by role and text; repeated rows stand as
    often as they do. A null text is empty, a null role is the empty role, a null conversation is one more
    conversation. ``part`` orders the parts; ``whole`` says that there is no other. ``loss`` marks the
    tokens of learned texts, none of the control ids. Other columns are ignored; no rows give no rows.
    """
    own = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    turns = rows.select(*[F.col(f"`{c}`").alias(name) for name, c in own.items()])
    dealt = turns.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, pattern, template))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shared.value)
        base = TaskContext.get().partitionId() << 33
        made, pieces, learned, count, size, number = [], [], [], 0, 0, 0
        now, first, split, none, chars = None, True, False, True, 0

        def end(closed: bool) -> None:
            nonlocal pieces, learned, count, size, number
            ids, loss = assemble(pieces, learned)
            made.append((now, base + number, closed and not first and not split, count, ids, loss))
            pieces, learned, count, size, number = [], [], 0, 0, number + 1

        for batch in batches:
            convs, roles, texts = batch.column(0).to_pylist(), batch.column(2).fill_null("").to_pylist(), batch.column(3).fill_null("").to_pylist()
            for conv, role, text in zip(convs, roles, texts):
                if none:
                    now, none = conv, False
                elif conv != now:
                    if count:
                        end(True)
                    now, first, split = conv, False, False
                added, at = coder.turn(role, text)
                if role in template.learned:
                    learned.append(len(pieces) + at)
                pieces += added
                count, size, chars = count + 1, size + sum(map(len, added)), chars + len(text)
                if size >= part_tokens:
                    split = True
                    end(False)
                if chars >= EMIT_CHARS:
                    if made:
                        yield _parts(made, batch.schema.field(0).type)
                    made, chars = [], 0
        if count:
            end(False)  # it may go on in the next partition
        if made:
            yield _parts(made, batch.schema.field(0).type)

    schema = T.StructType([turns.schema["conv_id"]]).add("part", "long").add("whole", "boolean").add("n_turns", "long").add("ids", T.ArrayType(T.IntegerType())).add("loss", T.ArrayType(T.BooleanType()))
    return dealt.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _parts(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, part, whole, count, ids, loss = zip(*made)
    arrays = [pa.array(conv, kind), pa.array(part, pa.int64()), pa.array(whole, pa.bool_()), pa.array(count, pa.int64()), _lists(list(ids), pa.int32()), _lists(list(loss), pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "whole", "n_turns", "ids", "loss"])


def conversation_digests(parts: DataFrame, vocabulary: bytes, pattern: str, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its ids: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    ``turns_sha256`` digests role, line break, text and line break of each turn; the loss columns are
    those of the texts under the mask. A conversation in one part is digested where it stands. Those of
    several parts are read in order, a part at a time, by the task that keeps their running digest.
    """
    shared = parts.sparkSession.sparkContext.broadcast((vocabulary, pattern, template))
    key = parts.schema["conv_id"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shared.value)
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, mask = batch.column(4)[k].values.to_numpy(), batch.column(5)[k].values.to_numpy(zero_copy_only=False)
                turns, chars, n = [], 0, 0
                for role, text, size in coder.turns(ids):
                    turns += [role, "\n", text, "\n"]
                    chars, n = chars + size, n + 1
                story, learned = "".join(turns), "".join(coder.under(ids, mask))
                whole = batch.column(2)[k].as_py()
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (story, learned)] if whole else [None, None]
                out.append((n, digests[0], len(learned), digests[1], chars, None if whole else story, None if whole else learned))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    names = ["conv_id", "part", "whole", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "story", "learned"]
    schema = T.StructType([key]).add("part", "long").add("whole", "boolean").add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long").add("story", "string").add("learned", "string")
    found = reliable_checkpoint(parts.mapInArrow(read, schema))
    result = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind, done = None, None, []
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, n, chars, size, story, learned in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(held)
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1], held[3], held[5] = held[1] + n, held[3] + chars, held[5] + size
                held[2].update(story.encode())
                held[4].update(learned.encode())
            if done:
                yield _digested(done, kind, result)
            done = []
        if held is not None:
            yield _digested([held], kind, result)

    cut = found.filter("NOT whole").select("conv_id", "part", "n_turns", "loss_chars", "formatted_chars", "story", "learned")
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "n_turns", "loss_chars", "formatted_chars", "story", "learned")
    return found.filter("whole").select(*result).unionByName(cut.mapInArrow(follow, T.StructType([key]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")))


def _digested(done: list[list], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    conv, n, story, chars, learned, size = zip(*done)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, kind), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in story]), pa.array(chars, pa.int64()), pa.array([h.hexdigest() for h in learned]), pa.array(size, pa.int64())], names
    )
