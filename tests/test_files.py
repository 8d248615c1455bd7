"""File layouts written to a temporary folder and read back."""

import json
import struct
import wave
from pathlib import Path

import pytest

from tidewell.sinks import files as sink
from tidewell.sources import files as src
from tidewell.sources import registry as reg


def test_official_labels_with_aliases_and_bom(spark, tmp_path):
    (tmp_path / "train_split_Depression.csv").write_text("﻿Participant_ID,PHQ8_Binary,Gender\n300_P,1,1\n301,0,\n", encoding="utf-8")
    (tmp_path / "dev_split.csv").write_text("participant_id,label\n302,excluded\n", encoding="utf-8")
    (tmp_path / "notes.csv").write_text("id,label\n1,1\n", encoding="utf-8")
    rows = {r["participant_id"]: (r["split"], r["label"], r["gender"]) for r in src.split_labels(spark, str(tmp_path)).collect()}
    assert rows == {"300": ("train", "depression", "1"), "301": ("train", "normal", None), "302": ("dev", "excluded", None)}


def test_numbered_labels(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("index,label,duration,gender,fold\n0,depression,100.0,f,valid\n1,normal,x,m,train\n", encoding="utf-8")
    rows = {r["participant_id"]: (r["label"], r["split"], r["duration"]) for r in src.numbered_labels(spark, str(path)).collect()}
    assert rows == {"0": ("depression", "dev", 100.0), "1": ("normal", "train", None)}


@pytest.mark.parametrize("sep", ["\t", ","])
def test_transcripts(spark, tmp_path, sep):
    lines = ["start_time stop_time speaker value", "1.0 2.5 Participant I~feel~sad", "3.0  Ellie okay"]
    (tmp_path / "300_TRANSCRIPT.csv").write_text("\n".join(x.replace(" ", sep).replace("~", " ") for x in lines), encoding="utf-8")
    rows = sorted(src.transcripts(spark, str(tmp_path)).collect(), key=lambda r: r["ord"])
    assert [(r["speaker"], r["text"], r["start_time"], r["stop_time"], r["duration"]) for r in rows] == [
        ("Participant", "I feel sad", 1.0, 2.5, 1.5), ("Ellie", "okay", 3.0, 3.0, 0.0)]


def test_interview_layout(spark, tmp_path):
    base = tmp_path / "300_P"
    base.mkdir()
    for name in ("300_AUDIO.wav", "300_TRANSCRIPT.csv", "300_CLNF_AUs.txt", "clip.mp4"):
        (base / name).write_bytes(b"x")
    rows = {r["modality"]: r["sample_id"] for r in reg.discover(spark, "daic_woz", str(tmp_path)).collect()}
    assert rows == {"audio": "300_audio_300_AUDIO", "text": "300_text_300_TRANSCRIPT", "video": "300_video_clip"}
    kinds = {r["name"]: r["modality"] for r in src.listing(spark, str(tmp_path)).collect()}
    assert kinds["300_CLNF_AUs.txt"] == "facial_features" and kinds["300_TRANSCRIPT.csv"] == "transcript"


def test_numbered_layout(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "7_acoustic.npy").write_bytes(b"x")
    (tmp_path / "8_visual.npy").write_bytes(b"x")
    rows = {(r["participant_id"], r["modality"]) for r in reg.discover(spark, "dvlog", str(tmp_path)).collect()}
    assert rows == {("7", "audio"), ("8", "visual")}
    with pytest.raises(KeyError):
        reg.discover(spark, "other", str(tmp_path))


def test_wav_header(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(struct.pack("<h", 1) * 8000)
    row = src.wav_header(spark, str(tmp_path)).first()
    assert (row["channels"], row["sample_rate"], row["bit_depth"], row["duration_seconds"]) == (1, 16000, 16, 0.5)


def test_lexicons_replace_defaults(spark, tmp_path):
    (tmp_path / "sleep.txt").write_text("# words\nInsomnia\n\nnap\n", encoding="utf-8")
    defaults = spark.createDataFrame([("sleep", "tired"), ("stress", "tension")], "category STRING, term STRING")
    rows = {(r["category"], r["term"]) for r in src.lexicons(spark, str(tmp_path), defaults).collect()}
    assert rows == {("sleep", "insomnia"), ("sleep", "nap"), ("stress", "tension")}


def test_index_and_fallback(spark, tmp_path):
    rows = [("300", "300", "daic_woz", "audio", "/d/300_AUDIO.wav", "normal", "train", "en", 100.0, 500, 0.85, 0.9),
            ("300", "300", "daic_woz", "transcript", "/d/300_T.csv", "normal", "train", "en", 100.0, 500, 0.85, 0.9),
            ("1", "1", "dvlog", "audio", "/d/1.npy", "depression", None, "en", 0.0, 0, 0.0, 0.5)]
    index = spark.createDataFrame(rows, src.INDEX_DDL)
    paths = sink.export_index(index, str(tmp_path))
    got = {r["participant_id"]: r for r in src.sessions_or_index(spark, str(tmp_path / "none.parquet"), paths["csv"]).collect()}
    assert got["300"]["has_audio"] and got["300"]["has_transcript"] and not got["300"]["has_visual"]
    assert got["1"]["quality_score"] == 0.8 and got["1"]["split"] == "unknown"


def test_graph_files_keep_header_and_footer(spark, tmp_path):
    node = spark.createDataFrame([("a&b", "User"), ("c", "Session")], "node_id STRING, label STRING")
    edge = spark.createDataFrame([("a&b", "c", "HAS_SESSION")], "src STRING, dst STRING, rel_type STRING")
    paths = sink.write_graph(node, edge, str(tmp_path))
    parts = sorted(p for p in (tmp_path / "graphml").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("<graphml") and text.strip().endswith("</graphml>") and "a&amp;b" in text
    lines = [x for p in (tmp_path / "edges.json").glob("part-*.json") for x in p.read_text().splitlines()]
    assert [json.loads(x)["src"] for x in lines] == ["a&b"] and set(paths) >= {"nodes_csv", "edges_json", "graphml"}


def test_failure_capture(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "k STRING, v INT")
    rows = {r["key"]: (r["result"], r["error"]) for r in reg.map_rows(df, "k", "v", lambda x: 10 // x).collect()}
    assert rows["a"] == ("10", None) and rows["b"][1].startswith("ZeroDivisionError")


def test_quoted_transcripts(spark, tmp_path):
    (tmp_path / "1_TRANSCRIPT.csv").write_text(
        'start_time,stop_time,speaker,value\n1.0,2.0,Participant,"Well, I slept badly"\n\n2.0,3.5,Ellie,"She said ""no"",\nthen left"\n3.5,4,Participant,5" long\n4,5,"",\n', encoding="utf-8")
    (tmp_path / "2_TRANSCRIPT.csv").write_text('﻿Start_Time\tStop_Time\tSpeaker\tText\n1\t2\tEllie\ta, b\n2\t3\tEllie\t"tab\there"\n', encoding="utf-8")
    (tmp_path / "3_TRANSCRIPT.csv").write_text("start_time,stop_time,speaker,value\n", encoding="utf-8")
    (tmp_path / "4_TRANSCRIPT.csv").write_text("", encoding="utf-8")
    rows = sorted((r["file"][-16:-15], r["ord"], r["speaker"], r["start_time"], r["stop_time"], r["text"]) for r in src.transcripts(spark, str(tmp_path)).collect())
    assert rows == [
        ("1", 0, "Participant", 1.0, 2.0, "Well, I slept badly"), ("1", 1, "Ellie", 2.0, 3.5, 'She said "no", then left'), ("1", 2, "Participant", 3.5, 4.0, '5" long'), ("1", 3, "unknown", 4.0, 5.0, ""),
        ("2", 0, "Ellie", 1.0, 2.0, "a, b"), ("2", 1, "Ellie", 2.0, 3.0, "tab here")]


def test_metadata_tables_take_the_first_record(spark, tmp_path):
    from tidewell.operators import dataset as ds
    from tidewell.sinks import files as sink
    rows = [
        ("p1", "s1", "daic", "normal", "en", "audio", "x1", "b.wav", 2.5), ("p1", "s1", "dvlog", "depression", "ta", "text", "x2", "a.csv", 0.0),
        ("p1", "s2", "daic", None, "en", "video", "x3", "c, d.avi", None), (None, None, "daic", "normal", None, "audio", "x4", "e.wav", 1.0),
    ]
    index = spark.createDataFrame(rows, "participant_id string, session_id string, dataset string, label string, language string, modality string, sample_id string, file_path string, duration_seconds double")
    tables = ds.metadata_tables(index)
    people = {r["participant_id"]: tuple(r)[1:] for r in tables["participants"].collect()}
    assert people == {"p1": ("dvlog", "depression", "ta"), None: ("daic", "normal", None)}
    assert {r["session_id"]: tuple(r)[1:] for r in tables["sessions"].collect()} == {"s1": ("p1", "dvlog"), "s2": ("p1", "daic"), None: (None, "daic")}
    assert tables["labels"].count() == tables["languages"].count() == 2
    paths = sink.write_metadata(tables, str(tmp_path))
    back = spark.read.option("header", True).csv(paths["files"])
    assert {(r["modality"], r["sample_id"], r["file_path"], r["duration_seconds"]) for r in back.collect()} == {
        ("audio", "x1", "b.wav", "2.5"), ("text", "x2", "a.csv", None), ("video", "x3", "c, d.avi", None), ("audio", "x4", "e.wav", "1.0")}
    empty = ds.metadata_tables(index.limit(0))
    assert all(t.count() == 0 for t in empty.values())


def test_layouts_with_and_without_labels(spark, tmp_path):
    from tidewell.sources import registry as reg
    deep = tmp_path / "a" / "7_P" / "participant_data" / "text"
    deep.mkdir(parents=True)
    (deep / "0.txt").write_text("hello")
    numbers = tmp_path / "b" / "12"
    numbers.mkdir(parents=True)
    (numbers / "acoustic.npy").write_bytes(b"")
    bare = [(r["participant_id"], r["modality"], r["label"], r["split"]) for r in reg.discover_all(spark, {"daic_woz": str(tmp_path / "a"), "dvlog": str(tmp_path / "b")}).collect()]
    assert sorted(bare) == [("12", "audio", "unknown", None), ("7", "text", "unknown", None)]
    (tmp_path / "a" / "splits").mkdir()
    (tmp_path / "a" / "splits" / "dev_split.csv").write_text("Participant_ID,PHQ8_Binary\n7_P,1\n")
    (tmp_path / "b" / "labels.csv").write_text("index,label,fold\n12,0,valid\n")
    full = [(r["participant_id"], r["label"], r["split"]) for r in reg.discover_all(spark, {"daic_woz": str(tmp_path / "a"), "dvlog": str(tmp_path / "b")}).collect()]
    assert sorted(full) == [("12", "normal", "dev"), ("7", "depression", "dev")]


def test_many_small_transcripts_are_few_tasks_and_one_parse(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"{k}.csv").write_text(f"start_time\tspeaker\tvalue\n{k}\ta\tx, y\n{k}\tb\tz\n")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = src.delimited_records(spark, str(tmp_path), "*.csv")
    assert 1 <= len(read.inputFiles()) <= few  # commas are not tried, as all files have tabs
    assert sorted((r["ord"], r["cells"][0]) for r in read.collect()) == sorted((o, str(k)) for k in range(100) for o in (0, 1))
    (tmp_path / "c.csv").write_text("start_time,speaker,value\n7,c,w\n")
    read = src.delimited_records(spark, str(tmp_path), "*.csv")
    assert len(read.inputFiles()) <= 2 * few
    assert [r["cells"][:3] for r in read.filter("file LIKE '%c.csv'").collect()] == [["7", "c", "w"]] and read.count() == 201


def test_small_files_are_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("CAST(id % 40 AS STRING) AS participant_id", "id AS ord", "0D AS start_time", "'a' AS speaker", "'x' AS text")
    path = sink.export_transcripts(rows, str(tmp_path))
    names = [Path(f).name for f in spark.read.json(path).inputFiles()]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1


def test_pieces_of_conversations_share_folders(spark, tmp_path):
    from tidewell.bindings import Tables
    from tidewell.plans.files import write_pieces

    lines = spark.createDataFrame([(c, t, f"{c}:{t}") for c in (-1, 0, 1, 999, 1000) for t in (1, 0, 1000)], "conv_id BIGINT, turn BIGINT, l STRING")
    folder = Path(write_pieces(Tables(spark, ""), lines, "h\n", str(tmp_path / "p")))
    assert {str(f.relative_to(folder)): f.read_text() for f in folder.rglob("*.txt")} == {
        f"shard={c // 1000 if c > 0 else 0}/conv_id={c}-{p}.txt": f"h\n{c}:0\n{c}:1\n" if p == 0 else f"h\n{c}:1000\n" for c in (-1, 0, 1, 999, 1000) for p in (0, 1)}
