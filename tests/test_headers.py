"""Media and array headers: real files against the standard readers, damaged ones against their reasons."""

import io
import struct
import wave

import numpy as np
import pytest

from tidewell.sinks import files as sink
from tidewell.sources import files as src
from tidewell.sources import headers as hd


def sound(rate=16000, frames=100, channels=2, width=2, extra=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"\0" * frames * channels * width)
    data = out.getvalue()
    return data[:12] + extra + data[12:]


def avi(frames=50, micros=40000):
    body = b"hdrl" + b"avih" + struct.pack("<I", 56) + struct.pack("<10I", micros, 0, 0, 0, frames, 0, 1, 0, 320, 240) + b"\0" * 16
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"AVI " + b"LIST" + struct.pack("<I", len(body)) + body


def box(name, body):
    return struct.pack(">I4s", len(body) + 8, name) + body


def mp4(count=75, scale=1000, ticks=3000, wide=False):
    clock = struct.pack(">BxxxQQIQ", 1, 0, 0, scale, ticks) if wide else struct.pack(">IIIII", 0, 0, 0, scale, ticks)
    track = box(b"tkhd", b"\0" * 76 + struct.pack(">II", 640 << 16, 480 << 16)) + box(b"mdia", box(b"mdhd", clock) + box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 12)
                + box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 0, count)))))
    tone = box(b"mdia", box(b"hdlr", b"\0" * 8 + b"soun" + b"\0" * 12))
    # samples before the tables, with a 64-bit length
    return box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + 1000) + b"x" * 1000 + box(b"moov", box(b"trak", tone) + box(b"trak", track))


@pytest.mark.parametrize("wide", [False, True])
def test_readers(wide):
    def read(reader, data):
        return reader(io.BytesIO(data), len(data))

    assert read(hd.wav, sound(extra=b"LIST" + struct.pack("<I", 5) + b"notes\0")) == {"channels": 2, "sample_rate": 16000, "bit_depth": 16, "frames": 100, "seconds": 100 / 16000}
    assert read(hd.avi, avi()) == {"frames": 50, "fps": 25.0, "seconds": 2.0, "width": 320, "height": 240}
    assert read(hd.mp4, mp4(wide=wide)) == {"frames": 75, "fps": 25.0, "seconds": 3.0, "width": 640, "height": 480}
    for shape in ((), (0,), (7,), (3, 5), (2, 3, 4)):
        out = io.BytesIO()
        np.save(out, np.zeros(shape, "<f8"))
        assert read(hd.npy, out.getvalue())["shape"] == list(shape)
    for reader, data in ((hd.wav, sound()), (hd.avi, avi()), (hd.mp4, mp4(wide=wide))):
        # cut anywhere before its tables end, a file is damaged, never a crash or a guess
        for n in range(0, 44 if reader is hd.wav else len(data) - (20 if reader is hd.avi else 0), 7):
            with pytest.raises((hd.HeaderError, struct.error)):
                read(reader, data[:n])


def test_few_bytes_are_read():
    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            self.read_bytes += n
            return super().read(n)

    f = Counting(sound(frames=1_000_000))
    assert hd.wav(f, len(f.getvalue()))["frames"] == 1_000_000 and f.read_bytes < 100


def test_rules_over_files(spark, tmp_path):
    out = io.BytesIO()
    np.save(out, np.zeros((40, 3), "<f4"))
    files = {
        "1/good.wav": sound(), "1/odd rate.wav": sound(rate=12345), "2/none.wav": sound(frames=0), "2/text.wav": b"hello, this is text", "2/empty.WAV": b"",
        "3/clip.mp4": mp4(), "3/still.avi": avi(frames=0), "4_acoustic.npy": out.getvalue(), "4_visual.npy": out.getvalue()[:-1], "5_visual.npy": out.getvalue(), "5/x y_TRANSCRIPT.csv": b" \n\t\n", "5/y_TRANSCRIPT.csv": b"\n a", "5/z_TRANSCRIPT.csv": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in files.items()], "name STRING, content BINARY")
    written = sink.write_blobs(rows, str(tmp_path / "f"))
    assert {r["file_path"].removeprefix(f"file:{tmp_path}/f/"): r["size"] for r in written.collect()} == {k: len(v or b"") for k, v in files.items()}
    folder = str(tmp_path / "f")
    listed = src.listing(spark, folder).selectExpr("file_path", "regexp_extract(file_path, '/f/([0-9])', 1) AS participant_id")
    owners = listed.unionByName(spark.createDataFrame([(f"file:{folder}/gone.wav", "9"), (None, "8")], "file_path STRING, participant_id STRING"))
    headers = hd.media_headers(owners)
    found = hd.file_errors(headers).unionByName(hd.transcript_errors(owners.filter("file_path LIKE '%TRANSCRIPT%'")))
    got = {(r["message"], r["severity"], r["check"], r["participant_id"]) for r in hd.file_issues(found, owners).collect()}
    assert got == {
        ("odd rate.wav: unexpected_sample_rate:12345", "warning", "audio_validation", "1"),
        ("none.wav: zero_duration", "warning", "audio_validation", "2"), ("text.wav: unreadable:not a RIFF file of this kind", "error", "audio_validation", "2"),
        ("empty.WAV: unreadable:file ends inside its header", "error", "audio_validation", "2"), ("still.avi: no_frames", "warning", "video_validation", "3"),
        ("4_visual.npy: unreadable:file ends inside its data", "error", "array_validation", "4"), ("gone.wav: missing", "error", "audio_validation", "9"),
        ("x y_TRANSCRIPT.csv: empty_transcript", "warning", "transcript_validation", "5"), ("z_TRANSCRIPT.csv: empty_transcript", "warning", "transcript_validation", "5"),
    }
    arrays = src.numbered_files(spark, folder)
    rows = {r["participant_id"]: tuple(r)[1:] for r in hd.array_participants(arrays, hd.media_headers(arrays)).collect()}
    assert rows == {"4": (40.0, None, "", "unreadable:file ends inside its data"), "5": (None, 40.0, "audio", "")}


def test_empty_list(spark):
    none = spark.createDataFrame([], "file_path STRING, participant_id STRING")
    assert hd.file_issues(hd.file_errors(hd.media_headers(none)), none).count() == 0
