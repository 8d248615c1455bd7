"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF.

The patterns give the base spans: email, ip, card (Luhn), phone. The model is trained in numpy on
windows of a bounded sample of documents, labelled with their base spans, and on the same windows with
values planted in further forms (phones without a plus sign, cards with dots, spaced emails) and with
look-alikes that are no personal data (dates, versions, hex digests). Each kind needs a digit or an @,
so windows without either are decoded only where they stand beside one that has it, or a span runs into
them; all others of every text are.

Windows of 64 characters overlap by half. Connected windows are one stretch: the emissions of both
windows of a place are averaged and the CRF decodes the stretch as one sequence, which is widened while
a span touches its edge. So a span has no greatest length and no edge cuts it. Spans are reconciled over
the whole text, surest first. A model span is kept if it is
sure enough, has the right digits, and no base span overlaps it; its kind is written ``model_...``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_text, slices, texts_of
from tidewell.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
WRITTEN = KINDS + tuple(f"model_{k}" for k in KINDS)
WIDTH, STRIDE = 64, 32
#: Weight of a window's emission at each of its places, where two windows meet.
CENTRAL = np.minimum(np.arange(WIDTH) + 1.0, WIDTH - np.arange(WIDTH))
#: Characters decoded at a time, or one stretch.
DECODED = 16_384
#: Documents of the training sample (those with a digit or @ and the smallest hash of their id), windows taken of each, and planted windows.
SAMPLE_ROWS = 300
SAMPLE_WINDOWS = 3
PLANTED = 1000
#: Least certainty of a span, at its least certain place; the checks of ``valid`` follow.
SURE = 0.35

# The domain decides where an email ends; its start is the run of name characters before the @.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME = re.compile(r"[A-Za-z0-9._%+-]*")
# A run of digits that no three parts follow cannot hold a start either, so it is passed over whole.
IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def name_start(text: str, low: int, at: int) -> int:
    """Where the run of name characters that ends at ``at`` begins, not before ``low``; looks no further left than four times the run."""
    size = 64
    while True:
        first = max(low, at - size)
        run = NAME.match(text[first:at][::-1]).end()
        if run < at - first or first == low:
            return at - run
        size *= 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of name@domain, in time linear in the text."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        low = name_start(text, end, at)
        domain = DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            end = domain.end()
            found.append((low, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern spans in code points, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def _code_table() -> np.ndarray:
    """Digits share a code, as do lower-case and capital letters; other ASCII characters have one each."""
    table = np.full(1 << 16, 4, np.int64)
    for point in range(1 << 16):
        c = chr(point)
        if c.isalpha():
            table[point] = 3 if c.isupper() else 2
    table[48:58] = 1
    others = [p for p in range(9, 127) if not chr(p).isalnum()]
    table[others] = 5 + np.arange(len(others))
    return table


CODES = 5 + 127


def encode(windows: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, mask = np.zeros((len(windows), WIDTH), np.int64), np.zeros((len(windows), WIDTH), bool)
    for k, w in enumerate(windows):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[k, : len(points)] = table[np.minimum(points, 0xFFFF)]
        mask[k, : len(points)] = True
    return codes, mask


def last_window(length: int) -> int:
    """Number of the last window on the grid that covers a text of this length."""
    return max(0, -(-(length - WIDTH) // STRIDE))


def stretches_of(text: str) -> list[tuple[int, int]]:
    """First and last window of each connected run of windows that hold a trigger or are next to one that does."""
    last, out = last_window(len(text)), []
    for k in (a // STRIDE for a in window_starts(text)):
        low, high = max(k - 1, 0), min(k + 1, last)
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a trigger, on a grid of half windows that covers the text."""
    last = last_window(len(text))
    hit: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        hit.add(min(k, last))
        hit.add(min(max(k - 1, 0), last))
    return [k * STRIDE for k in sorted(hit)]


# Training ---------------------------------------------------------------------------------------


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    body = "4" + _digits(rng, 14)
    body += next(c for c in "0123456789" if luhn(body + c))
    return str(rng.choice(["", " ", "-", "."])).join(body[k : k + 4] for k in range(0, 16, 4))


def _planted(rng: np.random.Generator) -> tuple[str, int]:
    """A value and its kind number, or -1 for a look-alike."""
    word = "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9)))
    host = "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9))) + str(rng.choice(["", "1", "7"]))
    end = str(rng.choice(["com", "org", "net", "de", "example.com", "co.uk"]))
    three, four, area = _digits(rng, 3), _digits(rng, 4), _digits(rng, 3)
    kind = int(rng.integers(0, 6))
    if kind == 0:
        at = str(rng.choice(["@", "@", "@", " @ "]))
        return word + str(rng.choice(["", "." + host, "_" + _digits(rng, 2), "." + _digits(rng, 2)])) + at + host + "." + end, 0
    if kind == 1:
        return ".".join(str(rng.integers(0, 256)) for _ in range(4)), 1
    if kind == 2:
        return _card(rng), 2
    if kind == 3:
        return str(rng.choice([f"+1 ({area}) {three}-{four}", f"({area}) {three}-{four}", f"{area}-{three}-{four}", f"{area}.{three}.{four}", f"+49 {area} {three}{four}", f"+{area[:2]}-{three}-{area}-{four}", f"00{area[:2]} {three} {area}{four}"])), 3
    hexed = "".join(rng.choice(list("0123456789abcdef"), rng.integers(12, 41)))
    return str(rng.choice([f"20{area[:2]}-0{1 + int(area[2]) % 9}-1{three[0]}", f"{area}.{three[:2]}", f"v{area[0]}.{area[1]}.{three[0]}", hexed, four, f"1{area}:{three[:2]}", f"#{four}{three}", f"{three},{area}.{four[:2]}", f"AKIA{word.upper()}{four}", f"@{word}", f"{four}-{four}"])), -1


def _truth(n: int, spans: Iterable[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for a, kind, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def train_tagger(windows: list[tuple[str, str]], plain: list[str], planted: int = PLANTED, seed: int = 17) -> Tagger:
    """From windows with a tag (one digit) for each place, and planted ones in plain stretches of text."""
    rng = np.random.default_rng(seed)
    texts, truths = [], []
    for w, tags in dict.fromkeys(windows):  # copies teach once
        texts.append(w)
        truths.append(np.array([*map(int, tags.ljust(WIDTH, "0"))]))
    plain = plain or ["the meeting is on and the rest of it was as said in that note "]
    for _ in range(planted):
        ground = plain[int(rng.integers(0, len(plain)))]
        value, kind = _planted(rng)
        at = int(rng.integers(0, max(1, min(len(ground), WIDTH - len(value)))))
        before = ground[:at]
        if before and not before[-1].isspace() and rng.random() < 0.9:
            before = before[:-1] + " "
        after = str(rng.choice([" ", " ", ", ", ". ", "\n", ") ", ""])) + ground[at:]
        texts.append((before + value + after)[:WIDTH])
        truths.append(_truth(WIDTH, [(len(before), kind, min(len(before) + len(value), WIDTH))] if kind >= 0 and len(before) < WIDTH else []))
    tagger = Tagger.fresh(CODES, 1 + 2 * len(KINDS))
    codes, mask = encode(texts, _code_table())
    tagger.train(codes, mask, np.where(mask, np.array(truths), 0))
    return tagger


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Train on a bounded sample of the documents; ids that are null are not sampled."""
    rows = id_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    chosen = [r[0] for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[tuple[str, str]]] = []
            grounds = []
            for text in texts_of(batch.column(1)):
                starts = window_starts(text)
                picked = starts[:: max(1, len(starts) // SAMPLE_WINDOWS)][:SAMPLE_WINDOWS]
                quiet = next((k for k in range(0, max(len(text) - WIDTH, 0), STRIDE) if not TRIGGER.search(text, k, k + WIDTH)), None)
                tags = _truth(len(text), base_spans(text)) if picked else np.zeros(0, np.int64)
                out.append([(text[a : a + WIDTH], "".join(map(str, tags[a : a + WIDTH].tolist()))) for a in picked])
                grounds.append("" if quiet is None else text[quiet : quiet + WIDTH])
            pairs = pa.list_(pa.struct([("text", pa.string()), ("tags", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pairs), pa.array(grounds, pa.string())], ["windows", "ground"])

    def fit(sample: pa.Table) -> pa.Table:
        # one group: the windows of at most SAMPLE_ROWS documents
        windows = sorted((w["text"], w["tags"]) for row in sample["windows"].to_pylist() for w in row)
        tagger = train_tagger(windows, sorted(g for g in sample["ground"].to_pylist() if g))
        return pa.table({"weights": pa.array([pickle.dumps(tagger.weights)], pa.binary())})

    kind = "array<struct<text:string,tags:string>>"
    schema = f"windows {kind}, ground string"
    empty = docs.sparkSession.range(1).select(F.array().cast(kind).alias("windows"), F.lit("").alias("ground"))
    sample = rows.filter(F.col("doc_id").isin(chosen)).mapInArrow(cut, schema).union(empty)
    # the sample is bounded, so one task fits it; there numpy runs on one core, as the executors set it
    weights = sample.groupBy(F.lit("all").alias("all")).applyInArrow(fit, "weights binary").first()[0]
    return Tagger(1 + 2 * len(KINDS), pickle.loads(weights))


# Decoding ---------------------------------------------------------------------------------------

Found = tuple[int, int, int, float]  # start, kind, end, certainty; relative to the window


def decode_windows(tagger: Tagger, windows: list[str], table: np.ndarray) -> list[list[Found]]:
    """Spans of each window, or stretch of windows on the grid; equal ones are decoded once.

    A place in two windows has the mean of both emissions, weighted by the distance to the window's edge,
    and the CRF decodes a stretch as one sequence.
    """
    made: dict[str, list[Found]] = {w: [] for w in windows if not w}
    distinct = sorted(dict.fromkeys(w for w in windows if w), key=lambda w: (len(w), w))
    while distinct:
        n = max(1, min(256, DECODED // len(distinct[0])))
        while n > 1 and n * len(distinct[min(n, len(distinct)) - 1]) > DECODED:
            n -= 1
        part, distinct = distinct[:n], distinct[n:]
        scores, mask = _emissions(tagger, part, table)
        tags = tagger.decode(scores, mask)
        sure = np.take_along_axis(tagger.marginals(scores, mask, pairs_too=False)[0], tags[:, :, None], 2)[:, :, 0]
        for w, row, p in zip(part, tags.tolist(), sure):
            spans, at = [], 0
            while at < len(w):
                if row[at] % 2 or (at == 0 and row[0]):  # begins a span, or goes on with one that began before
                    kind, end = (row[at] - 1) // 2, at + 1
                    while end < len(w) and row[end] == 2 + 2 * kind:
                        end += 1
                    spans.append((at, kind, end, float(p[at:end].min())))
                    at = end
                else:
                    at += 1
            made[w] = spans
    return [made[w] for w in windows]


def _emissions(tagger: Tagger, stretches: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, stretches))
    scores, weight = np.zeros((len(stretches), length, tagger.tags)), np.zeros((len(stretches), length))
    for parity in (0, 1):  # every other window: these do not overlap
        places = [(r, k * STRIDE) for r, s in enumerate(stretches) for k in range(parity, last_window(len(s)) + 1, 2)]
        for k in range(0, len(places), 256):
            part = places[k : k + 256]
            codes, mask = encode([stretches[r][a : a + WIDTH] for r, a in part], table)
            window, place = np.nonzero(mask)
            row, start = np.array(part).T
            at = row[window], start[window] + place
            scores[at] += tagger.emissions(codes, mask)[window, place] * CENTRAL[place, None]
            weight[at] += CENTRAL[place]
    mask = weight > 0
    return scores / np.where(mask, weight, 1.0)[:, :, None], mask


def model_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], table: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Model spans of each text. A stretch that a span may leave is widened, and decoded again, until none does."""
    found: dict[int, list[tuple[int, list[Found]]]] = {}
    todo = [(k, low, high) for k, t in enumerate(texts) for low, high in stretches_of(t)]
    while todo:
        cuts = [texts[k][low * STRIDE : high * STRIDE + WIDTH] for k, low, high in todo]
        wider = []
        for (k, low, high), cut, spans in zip(todo, cuts, decode_windows(tagger, cuts, table)):
            last = last_window(len(texts[k]))
            left = low > 0 and any(a == 0 for a, _, _, _ in spans)
            right = high < last and any(b == len(cut) for _, _, b, _ in spans)
            if left or right:
                more = high - low + 1
                wider.append((k, max(low - more * left, 0), min(high + more * right, last)))
            elif spans:
                found.setdefault(k, []).append((low * STRIDE, spans))
        todo = wider
    return [reconcile(t, base[k], found.get(k, ()), cut=False) for k, t in enumerate(texts)]


def reconcile(text: str, base: list[tuple[int, int, int]], found: Iterable[tuple[int, list[Found]]], sure: float = SURE, cut: bool = True) -> list[tuple[int, int, int]]:
    """Model spans of a whole text from those of its stretches, or of single windows, whose edges may ``cut`` spans."""
    best: dict[tuple[int, int, int], float] = {}
    for start, spans in found:
        for a, kind, b, p in spans:
            part = cut and ((a == 0 and start > 0) or (b == WIDTH and start + WIDTH < len(text)))
            if p >= sure and not part and valid(text[start + a : start + b], kind):
                key = (start + a, kind, start + b)
                best[key] = max(best.get(key, 0.0), p)
    taken, out = sorted((a, b) for a, _, b in base), []
    for (a, kind, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0][0] - x[0][2], x[0])):
        if all(b <= c or a >= d for c, d in taken):
            taken.append((a, b))
            out.append((a, 4 + kind, b))
    return out


def valid(value: str, kind: int) -> bool:
    """The digits and signs that a value of this kind must have."""
    digits = NOT_DIGIT.sub("", value)
    if kind == 0:
        tight = value.replace(" ", "")
        return emails(tight) == [(0, len(tight))]
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}", value)) and all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", value)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9().\x20-]*[0-9]", value)) and bool(re.search(r"[ ().-]", value))


def scan_personal(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base spans per kind, digest of the base spans, all spans, ``n_model``.

    Null counts as empty: no spans, digest of the empty text. Whole texts are read, in code points.
    Repeated rows give repeated results; other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            rows = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
            table = _code_table() if table is None else table
            added = model_spans(shared.value, texts, rows, table)
            counts = [pa.array([sum(1 for s in r if s[1] == k) for r in rows], pa.int64()) for k in range(4)]
            base = pa.array([hashlib.sha256(_written(r).encode()).hexdigest() for r in rows], pa.string())
            both = pa.array([_written(sorted(r + m)) for r, m in zip(rows, added)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, base, both, pa.array(list(map(len, added)), pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_model"],
            )

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long")


def _written(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{WRITTEN[k]}:{a}:{b}" for a, k, b in spans)
