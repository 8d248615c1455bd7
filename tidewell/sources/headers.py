"""Headers of media and array files, by ranged reads: a task opens a file and reads only the few bytes its chunks name."""

from __future__ import annotations

import ast
import codecs
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import rounded

# fixed values: sample rates that raise no warning
SAMPLE_RATES = (8000, 16000, 22050, 44100, 48000)
HEADER_DDL = (
    "file_path STRING, kind STRING, channels LONG, sample_rate LONG, bit_depth LONG, frames LONG, seconds DOUBLE, fps DOUBLE, "
    "width LONG, height LONG, shape ARRAY<LONG>, error STRING"
)
_SCHEMA = pa.schema([
    ("file_path", pa.string()), ("kind", pa.string()), ("channels", pa.int64()), ("sample_rate", pa.int64()), ("bit_depth", pa.int64()),
    ("frames", pa.int64()), ("seconds", pa.float64()), ("fps", pa.float64()), ("width", pa.int64()), ("height", pa.int64()),
    ("shape", pa.list_(pa.int64())), ("error", pa.string()),
])
# largest part of a header that is read at once; real ones have some hundred bytes
MOST_HEADER = 1 << 20


class HeaderError(ValueError):
    """The bytes do not form the header that the file's ending promises."""


def _read(f, at: int, size: int) -> bytes:
    if size > MOST_HEADER:
        raise HeaderError("header too large")
    f.seek(at)
    data = f.read(size)
    if len(data) < size:
        raise HeaderError("file ends inside its header")
    return data


def riff_chunks(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start of the body, size) of the chunks in [at, end); bodies are skipped, not read."""
    while at + 8 <= end:
        name, size = struct.unpack("<4sI", _read(f, at, 8))
        yield name, at + 8, size
        at += 8 + size + size % 2


def _riff(f, form: bytes, size: int) -> int:
    name, _, found = struct.unpack("<4sI4s", _read(f, 0, 12))
    if name != b"RIFF" or found != form:
        raise HeaderError("not a RIFF file of this kind")
    return size


def wav(f, size: int) -> dict:
    """Format and frame count of PCM audio; chunks before the samples may be of any kind and length."""
    fmt = frames = None
    for name, at, length in riff_chunks(f, 12, _riff(f, b"WAVE", size)):
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", _read(f, at, 16))
            if fmt[0] not in (1, 0xFFFE):
                raise HeaderError("samples are not PCM")
            if not fmt[1] or not fmt[5]:
                raise HeaderError("no channels or no bits")
        elif name == b"data":
            if fmt is None:
                raise HeaderError("samples before their format")
            # a stream that was never closed states more than it holds
            frames = min(length, size - at) // (fmt[1] * ((fmt[5] + 7) // 8))
            break
    if frames is None:
        raise HeaderError("no samples chunk")
    rate = fmt[2]
    return {"channels": fmt[1], "sample_rate": rate, "bit_depth": (fmt[5] + 7) // 8 * 8, "frames": frames, "seconds": frames / rate if rate else 0.0}


def avi(f, size: int) -> dict:
    """Frame rate, count and size from the main header of an AVI file."""
    for name, at, length in riff_chunks(f, 12, _riff(f, b"AVI ", size)):
        if name == b"LIST" and _read(f, at, 4) == b"hdrl":
            for inner, start, _ in riff_chunks(f, at + 4, min(at + length, size)):
                if inner == b"avih":
                    v = struct.unpack("<10I", _read(f, start, 40))
                    return _video(v[4], 1e6 / v[0] if v[0] else None, v[8], v[9])
    raise HeaderError("no main header")


def _video(frames: int, fps: float | None, width: int, height: int) -> dict:
    return {"frames": frames, "fps": fps, "seconds": frames / fps if fps else None, "width": width, "height": height}


def boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the body, end) of the boxes in [at, end) of an ISO media file."""
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", _read(f, at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", _read(f, at + 8, 8))[0], 16
        stop = end if size == 0 else at + size
        if stop < at + head or stop > end:
            raise HeaderError("box of wrong size")
        yield name, at + head, stop
        at = stop


def mp4(f, size: int) -> dict:
    """Frame rate, count and size of the first video track; boxes off the way to it are skipped."""
    def inside(at: int, end: int, *names: bytes) -> Iterator[tuple[int, int]]:
        for name, start, stop in boxes(f, at, end):
            if name == names[0]:
                if len(names) == 1:
                    yield start, stop
                else:
                    yield from inside(start, stop, *names[1:])

    for track in inside(0, size, b"moov", b"trak"):
        if not any(_read(f, at + 8, 4) == b"vide" for at, _ in inside(*track, b"mdia", b"hdlr")):
            continue
        out: dict = {}
        for at, stop in inside(*track, b"tkhd"):
            out["width"], out["height"] = (x >> 16 for x in struct.unpack(">II", _read(f, stop - 8, 8)))
        for at, _ in inside(*track, b"mdia", b"mdhd"):
            wide = _read(f, at, 1) == b"\x01"
            out["scale"], out["ticks"] = struct.unpack(">IQ" if wide else ">II", _read(f, at + (20 if wide else 12), 12 if wide else 8))
        for at, _ in inside(*track, b"mdia", b"minf", b"stbl", b"stsz"):
            out["count"] = struct.unpack(">I", _read(f, at + 8, 4))[0]
        if not {"width", "scale", "count"} <= out.keys():
            raise HeaderError("video track without its tables")
        seconds = out["ticks"] / out["scale"] if out["scale"] else 0.0
        return _video(out["count"], out["count"] / seconds if seconds else None, out["width"], out["height"])
    raise HeaderError("no video track")


def npy(f, size: int) -> dict:
    """Shape of a stored array; the data behind its header must be as long as the shape says."""
    magic = _read(f, 0, 8)
    if magic[:6] != b"\x93NUMPY":
        raise HeaderError("not an array file")
    wide = magic[6] >= 2
    length = struct.unpack("<I" if wide else "<H", _read(f, 8, 4 if wide else 2))[0]
    start = 12 if wide else 10
    text = _read(f, start, length)
    try:
        head = ast.literal_eval(text.decode("utf-8" if magic[6] >= 3 else "latin1"))
        shape, descr = [int(n) for n in head["shape"]], head["descr"]
    except (ValueError, SyntaxError, KeyError, TypeError) as e:
        raise HeaderError("header is not a description") from e
    if isinstance(descr, str) and descr[1:2] in tuple("biufc"):
        cells = 1
        for n in shape:
            cells *= n
        if size < start + length + cells * int(descr[2:]):
            raise HeaderError("file ends inside its data")
    return {"shape": shape, "frames": shape[0] if shape else None}


def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders right inside each folder of a column of paths; hidden names are left out."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
    for batch in batches:
        for parent in batch.column(0).to_pylist():
            system, local = located(parent)
            found = [i for i in system.get_file_info(fs.FileSelector(local)) if not i.base_name.startswith((".", "_"))]
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pylist([
                    {"path": f"{parent.rstrip('/')}/{i.base_name}", "name": i.base_name, "size": i.size, "folder": i.type == fs.FileType.Directory}
                    for i in found[at:at + 10_000]], schema)


READERS = {".wav": ("audio", wav), ".avi": ("video", avi), ".mp4": ("video", mp4), ".m4v": ("video", mp4), ".mov": ("video", mp4), ".npy": ("array", npy)}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location; Hadoop writes local ones as file:/x and escapes nothing."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon and scheme == "file" else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def header_of(path: str) -> dict:
    """One file's header; an unreadable one gives ``error``, never an exception."""
    kind, reader = READERS["." + path.rsplit(".", 1)[-1].lower()]
    row = {"file_path": path, "kind": kind}
    try:
        system, local = located(path)
        with system.open_input_file(local) as f:
            return row | reader(f, f.size())
    except FileNotFoundError:
        return row | {"error": "missing"}
    except (HeaderError, struct.error) as e:
        return row | {"error": f"unreadable:{e}"}
    except OSError as e:
        return row | {"error": f"unreadable:{type(e).__name__}"}


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([header_of(p) for p in batch.column(0).to_pylist()], _SCHEMA)


def media_headers(files: DataFrame, path: str = "file_path", spread: int | None = None) -> DataFrame:
    """Header fields of every audio, video and array file of a path list (DQ20, SRC14).

    Files of other endings and null paths are left out; repeated paths are read once. Paths are dealt evenly over ``spread``
    tasks (by default the session's shuffle partitions), as a listing of many files is short in bytes but long in reads.
    A missing or damaged file is a row with ``error``. An empty list gives an empty table.
    """
    wanted = files.select(F.col(path).alias("file_path")).filter(F.lower("file_path").rlike(r"[.](?:" + "|".join(k[1:] for k in READERS) + ")$")).distinct()
    dealt = wanted.repartition(spread, "file_path") if spread else wanted.repartition("file_path")
    return dealt.mapInArrow(_headers, HEADER_DDL).withColumn("seconds", rounded("seconds", 3))


def file_errors(headers: DataFrame) -> DataFrame:
    """(file_path, modality, error) for the rules of audio and video files; a file may break several."""
    audio, video = F.col("kind") == "audio", F.col("kind") == "video"
    sound = F.col("error").isNull()
    found: list[Column] = [
        F.col("error"),
        F.when(audio & sound & (F.col("seconds") <= 0), "zero_duration"),
        F.when(audio & sound & ~F.col("sample_rate").isin(*SAMPLE_RATES), F.concat(F.lit("unexpected_sample_rate:"), F.col("sample_rate").cast("string"))),
        F.when(video & sound & (F.col("frames") <= 0), "no_frames"),
    ]
    return headers.select("file_path", F.col("kind").alias("modality"), F.explode(F.array_compact(F.array(*found))).alias("error"))


def blank_text(path: str) -> str | None:
    """``empty_transcript`` for a file of white space only; reading stops at the first block with anything else."""
    try:
        system, local = located(path)
        with system.open_input_stream(local) as f:
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            while block := f.read(MOST_HEADER):
                if decoder.decode(block).strip():
                    return None
            return None if decoder.decode(b"", True).strip() else "empty_transcript"
    except FileNotFoundError:
        return "missing"
    except OSError as e:
        return f"unreadable:{type(e).__name__}"


def _blanks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"file_path": pa.array(paths, pa.string()), "error": pa.array([blank_text(p) for p in paths], pa.string())})


def transcript_errors(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(file_path, modality, error) of transcript files that hold nothing but white space, or cannot be read."""
    wanted = files.select(F.col(path).alias("file_path")).dropna().distinct().repartition("file_path")
    rows = wanted.mapInArrow(_blanks, "file_path STRING, error STRING").dropna()
    return rows.select("file_path", F.lit("transcript").alias("modality"), "error")


def file_issues(errors: DataFrame, owners: DataFrame) -> DataFrame:
    """Issue rows of broken files: missing and unreadable ones are errors, the rest warnings (DQ20).

    ``owners`` has ``file_path, participant_id``; a file without an owner keeps a null one.
    """
    name = F.element_at(F.split("file_path", "/"), -1)
    return errors.join(owners.select("file_path", "participant_id").distinct(), "file_path", "left").select(
        F.lit("file").alias("gate"), F.concat("modality", F.lit("_validation")).alias("check"),
        F.when(F.col("error").rlike("missing|unreadable"), "error").otherwise("warning").alias("severity"),
        F.concat(name, F.lit(": "), F.col("error")).alias("message"), F.col("participant_id").cast("string").alias("participant_id"),
    )


def array_participants(files: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per participant of the array layout: audio length is the first dimension of the audio array (SRC14).

    ``files`` are rows of ``numbered_files``. Of several arrays of a kind the first path counts. A damaged array gives a null
    length and its reason; an array without dimensions a null length alone.
    """
    rows = files.select("participant_id", "modality", "file_path").join(headers.select("file_path", "frames", "error"), "file_path", "left")
    first = {
        m: F.min(F.when(F.col("modality") == m, F.struct("file_path", "frames", "error"))) for m in ("audio", "visual")
    }
    one = rows.groupBy("participant_id").agg(*[c.alias(f"_{m}") for m, c in first.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{m}").isNull(), m) for m in first]))
    return one.select(
        "participant_id", F.col("_audio.frames").cast("double").alias("audio_length"), F.col("_visual.frames").cast("double").alias("visual_length"),
        F.array_join(missing, ",").alias("missing_files"), F.concat_ws(",", "_audio.error", "_visual.error").alias("errors"),
    )
