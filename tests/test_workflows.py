from __future__ import annotations

import dataclasses
import gzip
import json
import math
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelight import cli
from cuelight.operators import intervals
from cuelight.plans import workflows
from cuelight.scratch import Folder, discard, shared_folder, written
from cuelight.sinks.files import jsonable, merge_manifest, write_json, write_lines, write_text
from cuelight.sinks.index_store import IndexStore, Task
from cuelight.sources.jsonl import read_json_lines
from cuelight.streaming.align import align_stream, read_segments


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return path


def read(path):
    """The lines of a file, or of a folder of parts in the order of their names."""
    parts = sorted(Path(path).glob("part-*")) if Path(path).is_dir() else [Path(path)]
    return [json.loads(line) for part in parts for line in part.read_text(encoding="utf-8").splitlines()]


def fake_tools(command):
    if command[0] == "ffprobe":
        return '{"streams": [{"width": 640, "height": 480, "r_frame_rate": "30/1"}], "format": {"duration": "3.5"}}'
    if command[-1].endswith(".jpg"):
        for i in (1, 2, 3):
            Path(command[-1].replace("%06d", f"{i:06d}")).touch()
    return ""


def config(tmp_path, **more):
    video = tmp_path / "my talk.mp4"
    video.touch()
    return workflows.IngestConfig(video_path=video, project_id="p", video_id="my_talk", output_root=tmp_path / "projects", **more)


def test_ingest_align_index_and_query(spark, tmp_path):
    (tmp_path / "my talk.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nthe red box\n\n2\n00:00:05,000 --> 00:00:06,000\nnothing\n")
    made = workflows.ingest_video(spark, config(tmp_path), fake_tools)
    assert made["transcript_source"] == "srt" and made["counts"] == {"lecture_segments": 2, "frames": 3}
    assert made["probe"] == {"duration_sec": 3.5, "width": 640, "height": 480, "r_frame_rate": "30/1"}
    assert made["transcript_config"]["stt_model"] is None
    project = tmp_path / "projects" / "p"
    rows = read(project / "segments" / "lecture_segments.jsonl")
    assert [r["segment_id"] for r in rows] == ["seg_my_talk_000001", "seg_my_talk_000002"] and rows[0]["slide_id"] is None
    assert [r["timestamp"] for r in read(project / "manifests" / "frames_manifest.jsonl")] == [0.0, 1.0, 2.0]
    summary = workflows.align_frames(spark, "p", tmp_path / "projects", 0.5, one_file=True)
    assert (project / "segments" / "lecture_segments_aligned.jsonl").is_file()
    assert summary["project_id"] == "p" and summary["paths"] == {
        "segments": f"{project}/segments/lecture_segments.jsonl", "frames_manifest": f"{project}/manifests/frames_manifest.jsonl",
        "aligned_segments": f"{project}/segments/lecture_segments_aligned.jsonl", "project_manifest": f"{project}/manifests/project_manifest.json",
    }
    assert summary["counts"] == {
        "margin_seconds": 0.5, "segments_total": 2, "segments_with_frames": 1, "segments_without_frames": 1, "frame_refs_total": 2,
        "unique_frames_referenced": 2,
    }
    aligned = read(project / "segments" / "lecture_segments_aligned.jsonl")
    assert aligned[0]["frame_refs"] == ["frame_000001", "frame_000002"] and aligned[1]["frame_refs"] == []
    manifest = json.loads((project / "manifests" / "project_manifest.json").read_text())
    assert manifest["counts"] == {"lecture_segments": 2, "frames": 3, "lecture_segments_aligned": 2}
    assert manifest["alignment"]["segments_with_frames"] == 1
    store = IndexStore(spark, tmp_path / "indexes")
    done = workflows.index_project(store, "i", project, batch_size=1, reset=True)
    assert (done["indexed_documents"], done["indexed_batches"]) == (2, 2) and done["segments_path"].endswith("aligned.jsonl")
    found = workflows.query_index(store, "i", "red box", 5)["candidates"]
    assert [c["segment_id"] for c in found] == ["seg_my_talk_000001"] and found[0]["timestamp_center"] == 0.5


def test_a_project_on_another_file_system(spark, tmp_path):
    """An output root with a scheme: tools write beside, all else is written by Spark."""
    (tmp_path / "talk.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nhello\n")
    root = f"file://{tmp_path}/elsewhere"
    made = workflows.ingest_video(spark, dataclasses.replace(config(tmp_path, srt_path=tmp_path / "talk.srt"), output_root=root), fake_tools)
    project = tmp_path / "elsewhere" / "p"
    assert made["artifacts"]["frames_dir"] == f"{root}/p/frames" and sorted(p.name for p in (project / "frames").glob("*.jpg"))[0] == "frame_000001.jpg"
    assert (project / "source" / "my talk.mp4").is_file() and not (project / "source" / "my talk.mp4").is_symlink()
    assert workflows.align_frames(spark, "p", root, 0.5)["counts"]["frame_refs_total"] == 2
    store = IndexStore(spark, f"file://{tmp_path}/indexes")
    assert workflows.index_project(store, "i", f"{root}/p")["indexed_documents"] == 1


def test_own_keys_become_attributes(spark, tmp_path):
    rows = [{"segment_id": "s", "transcript_text": "alpha", "topic": "x", "n": 1}, {"segment_id": "t", "transcript_text": "alpha beta", "topic": ["y"], "Topic": 3, "frame_refs": ["f"]}]
    lines(tmp_path / "p" / "segments" / "lecture_segments.jsonl", rows)
    store = IndexStore(spark, tmp_path / "indexes")
    workflows.index_project(store, "i", tmp_path / "p")
    docs = {r.segment_id: r for r in store.documents("i").selectExpr("segment_id", "frame_refs", "to_json(Topic) topic", "to_json(n) n").collect()}
    assert (docs["s"].n, docs["s"].topic, docs["t"].topic, docs["t"].frame_refs) == ("1", None, "3", ["f"])


def test_speech_to_text_and_no_transcript(spark, tmp_path):
    heard = {"segments": [{"start": 1, "end": 2, "text": " hi "}]}
    made = workflows.ingest_video(
        spark, config(tmp_path, skip_frames=True, stt_language="ko"), fake_tools, lambda audio, **options: heard | {"language": options["language"]}
    )
    assert made["transcript_source"] == "stt" and made["transcript_config"]["stt_language"] == "ko" and made["counts"]["frames"] == 0
    rows = read(made["artifacts"]["lecture_segments"])
    assert [(r["text"] if "text" in r else r["transcript_text"], r["source"]) for r in rows] == [("hi", "stt:mlx-whisper")]
    none = workflows.ingest_video(spark, config(tmp_path, skip_frames=True, transcript_source="none"), fake_tools)
    assert none["counts"]["lecture_segments"] == 0
    with pytest.raises(FileNotFoundError):
        workflows.ingest_video(spark, config(tmp_path, transcript_source="srt"), fake_tools)
    with pytest.raises(ValueError):
        workflows.ingest_video(spark, config(tmp_path, transcript_source="x"), fake_tools)


def test_align_keeps_unknown_keys(spark, tmp_path):
    lines(tmp_path / "p/segments/lecture_segments.jsonl", [{"segment_id": "s", "start_time": "1", "end_time": True, "extra": {"a": [1]}}])
    lines(tmp_path / "p/manifests/frames_manifest.jsonl", [{"frame_path": "/f/x.jpg", "timestamp": "1.0"}])
    workflows.align_frames(spark, "p", tmp_path)
    assert read(tmp_path / "p/segments/lecture_segments_aligned.jsonl") == [
        {"segment_id": "s", "start_time": "1", "end_time": True, "extra": {"a": [1]}, "frame_refs": ["x"]}
    ]
    with pytest.raises(FileNotFoundError):
        workflows.align_frames(spark, "q", tmp_path)


def test_aligned_lines_store_no_references_but_the_file(spark, tmp_path, monkeypatch):
    """Lines by runs of segments are the bytes that sorting all references gives, also in many ranges, one of them split; nothing is left in the shared folder, and parts may be compressed."""
    rng = random.Random(7)
    ends = lambda: rng.choice([rng.uniform(0, 900), str(rng.randrange(900)), None, "NaN", 450])
    lines(tmp_path / "p/segments/lecture_segments.jsonl", [{"frame_refs": 1, "start_time": ends(), "end_time": ends(), "é": [i, None]} for i in range(400)] + [{}])
    named = [{"frame_id": rng.choice(["a", 'q"\\\n', "é한", "", None]), "frame_path": rng.choice([None, "/x/y.jpg"])} for _ in range(1500)]
    lines(tmp_path / "p/manifests/frames_manifest.jsonl", [{**n, "timestamp": rng.choice([rng.uniform(-10, 1000), 450, "x", rng.randrange(900)])} for n in named])
    monkeypatch.setattr(intervals, "_RANGE_POINTS", 200)
    monkeypatch.setattr(intervals, "_LEAST_REFS", 1000)
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    done = workflows.align_frames(spark, "p", tmp_path, 0.5, output=tmp_path / "runs", compression="gzip")
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) == before
    parts = sorted((tmp_path / "runs").glob("part-*"))
    assert len(parts) > 3 and all(p.name.endswith(".gz") for p in parts)
    monkeypatch.setattr(intervals, "_BYTES_HELD", -1)
    assert workflows.align_frames(spark, "p", tmp_path, 0.5, output=tmp_path / "sorted")["counts"] == done["counts"]
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "sorted").glob("part-*")))
    assert b"".join(gzip.decompress(p.read_bytes()) for p in parts) == plain and plain.count(b"\n") == 401
    assert done["counts"]["frame_refs_total"] == sum(len(r["frame_refs"]) for r in read(tmp_path / "sorted")) > 50_000
    rows = read_json_lines(spark, str(tmp_path / "runs"), check=False).orderBy("position").select(F.to_json("v").alias("v"))
    assert [json.loads(r.v) for r in rows.collect()] == read(tmp_path / "sorted")
    with pytest.raises(ValueError):
        write_text(rows, tmp_path / "z", one_file=True, compression="gzip")


@pytest.mark.parametrize("segments, frames", [(0, 1), (1, 0), (0, 0)])
def test_align_nothing(spark, tmp_path, segments, frames):
    lines(tmp_path / "p/segments/lecture_segments.jsonl", [{"start_time": 1}] * segments)
    lines(tmp_path / "p/manifests/frames_manifest.jsonl", [{"frame_id": "f", "timestamp": 1}] * frames)
    done = workflows.align_frames(spark, "p", tmp_path)["counts"]
    assert list(done.values()) == [0.0, segments, 0, segments, 0, 0]
    assert read(tmp_path / "p/segments/lecture_segments_aligned.jsonl") == [{"start_time": 1, "frame_refs": []}] * segments


def test_lines_of_few_references_at_once(monkeypatch):
    """Names in the order of frames, over blocks of which few are open, and slices of some windows."""
    monkeypatch.setattr(intervals, "_REFS_AT_ONCE", 7)
    monkeypatch.setattr(intervals, "_BLOCKS_OPEN", 1)
    rng = random.Random(11)
    points = sorted((rng.randrange(-20, 60) / 4, i) for i in range(90))
    blocks = intervals._Blocks()
    for own in (points[:30], points[30:31], points[31:]):
        times, order = np.array([t for t, _ in own]), np.array([i for _, i in own])
        packed = intervals._packed(t=np.diff(times.view(np.int64), prepend=0)), intervals._packed(order=np.diff(order, prepend=0), name=[f"n{i}" for i in order])
        blocks.add(pa.RecordBatch.from_pydict({"times": [packed[0]], "named": [packed[1]]}))
    spans = [tuple(sorted((rng.uniform(-9, 20), rng.uniform(-9, 20)))) for _ in range(40)] + [(None, None), (math.nan, 9.0), (1.0, math.nan), (-math.inf, math.inf), (90.0, 91.0)]
    rows = pa.RecordBatch.from_pydict({"a": [a for a, _ in spans], "b": [b for _, b in spans], "head": [f"{i}:" for i in range(len(spans))]})
    got = [line for batch in blocks.lines(rows) for line in batch["value"].to_pylist()]
    within = lambda a, b: sorted(i for t, i in points if a is not None and a <= t <= b)
    assert got == [f"{n}:[{','.join(f'n{i}' for i in within(a, b))}]}}" for n, (a, b) in enumerate(spans)]


def test_evaluate_records(spark, tmp_path):
    path = lines(
        tmp_path / "r.jsonl",
        [
            {"sample_id": "a", "question": "alpha", "transcript_text": "alpha words", "timestamp_points": [100, 150], "video_name": "v"},
            {"sample_id": "b", "question": "beta", "transcript_text": "other", "timestamp_points": [], "video_name": "v"},
        ],
    )
    store = IndexStore(spark, tmp_path / "indexes")
    assert workflows.index_records(store, str(path), "i", batch_size=1) == {"index": "i", "indexed_documents": 2}
    out = tmp_path / "out" / "e.jsonl"
    got = workflows.evaluate_records(store, str(path), "i", deltas=[5, 30], output=out, one_file=True)
    assert got == {"count": 2, "mean_abs_error": 25.0, "hit_at_5s": 0.0, "hit_at_30s": 0.5}
    rows = read(out)
    assert rows[0]["hit_by_delta"] == {"5": False, "30": True} and rows[0]["topk_candidates"][0]["sample_id"] == "a"
    assert workflows.evaluate_records(store, str(path), "i", record_limit=0) == {"count": 0}


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, tmp_path)
    docs = lambda *rows: spark.createDataFrame(list(rows), "segment_id string, transcript_text string")
    assert store.health() == {"status": "available"}
    assert store.delete_index("i") is None
    with pytest.raises(LookupError):
        store.add_documents("i", docs(("a", "x")))
    assert store.create_index("i") and store.create_index("i") is None
    ask = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert store.search("i", ask) is None
    store.update_settings("i")
    store.wait(store.add_documents("i", docs(("s1", "alpha"), ("s2", "beta"))))
    store.wait(store.add_documents("i", docs(("s1", "gamma"), ("s3", "alpha"))))
    assert store.documents("i").count() == 3
    store.add_documents("i", docs(("s9", "first"), ("s8", "x"), ("s9", "last")).coalesce(1))
    assert {r.segment_id: r.transcript_text for r in store.documents("i").collect()}["s9"] == "last"
    for wrong in ({"where": {"transcript_text": "alpha"}}, {"sort": ["segment_id:asc"]}, {"sort": ["sample_index:up"]}):
        with pytest.raises(ValueError):
            store.search("i", ask, **wrong)
    other = IndexStore(spark, tmp_path)  # writers beside each other: numbers are claimed, not counted
    assert store.folder.claim("i/claims/00000003") and other.add_documents("i", docs(("s7", "y"))) and store.documents("i").count() == 6
    assert [r.segment_id for r in store.search("i", ask).collect()] == ["s3"]
    assert store.delete_index("i")
    assert store.create_index("../x") and store.create_index("a/b") and sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["%2E%2E%2Fx", "a%2Fb"]
    assert store.wait(None) is None
    with pytest.raises(RuntimeError):
        store.wait(Task(1, "failed"))
    with pytest.raises(TimeoutError):
        store.wait(Task(1, "enqueued"), timeout=0.1)


def test_json_files(spark, tmp_path):
    write_json(tmp_path / "a" / "m.json", {"p": Path("/x"), "k": "한", 1: [None]})
    assert (tmp_path / "a" / "m.json").read_text() == '{\n  "p": "/x",\n  "k": "한",\n  "1": [\n    null\n  ]\n}\n'
    (tmp_path / "b.json").write_text("[1]")
    home = Folder(spark, str(tmp_path))
    assert merge_manifest(home, "b.json", counts={"n": 1}, alignment={"x": 2}) == {"counts": {"n": 1}, "alignment": {"x": 2}}
    write_json(tmp_path / "c.json", {"counts": 3, "artifacts": {"a": 1}, "other": 4})
    assert merge_manifest(home, "c.json", counts={"n": 1}, artifacts={"b": 2}) == {"counts": {"n": 1}, "artifacts": {"a": 1, "b": 2}, "other": 4}
    df = spark.createDataFrame([(2, None), (3, "z"), (1, "é")], "o int, v string").repartition(3)
    for one_file in (True, False):
        assert write_lines(df, tmp_path / f"d{one_file}", "o", one_file=one_file) == 3
        assert read(tmp_path / f"d{one_file}") == [{"v": "é"}, {"v": None}, {"v": "z"}]
    assert (tmp_path / "dTrue").read_text() == '{"v":"é"}\n{"v":null}\n{"v":"z"}\n' and not (tmp_path / "dTrue.parts").exists()
    assert jsonable(({"a"}, 1))[1] == 1


def test_manifest_writers_lose_no_section(spark, tmp_path):
    home = Folder(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: merge_manifest(home, "m.json", counts={f"n{i}": i}, **{f"own{i}": i}), range(16)))
    made = json.loads((tmp_path / "m.json").read_text())
    assert made["counts"] == {f"n{i}": i for i in range(16)} and all(made[f"own{i}"] == i for i in range(16))
    assert home.claim(".m.json.versions/00000016.claim")  # of a writer that is gone
    assert merge_manifest(home, "m.json", most_seconds=0.2, alignment={"x": 1})["alignment"] == {"x": 1}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    parse = cli.build_parser().parse_args
    a = parse(["align-frames", "--project-id", "p"])
    assert (a.output_root, a.margin_seconds) == (Path("artifacts/projects"), 0.0)
    assert parse(["index-project", "--index", "i", "--project-dir", "d"]).batch_size == 500
    for wrong in (["index-project", "--index", "i"], ["index-project", "--index", "i", "--project-id", "p", "--project-dir", "d"], []):
        with pytest.raises(SystemExit):
            parse(wrong)
    i = parse(["ingest-video", "--video", "v", "--project-id", "p", "--stt-language", "en"])
    assert (i.stt_language, i.frame_rate, i.max_frames, i.transcript_source) == ("en", 1.0, 120, "auto")
    assert parse(["eval-records", "--input", "x", "--index", "i"]).deltas == "5,10,15"
    assert cli.main(["--index-root", str(tmp_path), "health"]) == 0
    assert json.loads(capsys.readouterr().out) == {"status": "available"}
    assert cli.main(["--index-root", str(tmp_path), "query", "--index", "none", "--query", "x"]) == 1
    assert "none" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    lines(tmp_path / "in" / "a.json", [{"segment_id": "s", "start_time": 1.0, "end_time": 2.0, "transcript_text": "t"}])
    frames = spark.createDataFrame([(0, "f", 1.5), (1, "g", 9.0)], "ordinal long, frame_id string, timestamp double")
    query = align_stream(read_segments(spark, str(tmp_path / "in")), frames, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    lines(tmp_path / "in" / "b.json", [{"segment_id": "u", "start_time": 8.0, "end_time": 9.0, "transcript_text": "t"}])
    time.sleep(0.1)
    query.processAllAvailable()
    query.stop()
    got = {r.segment_id: r.frame_refs for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"s": ["f"], "u": ["g"]}


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda _: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_spent_tables_go(spark):
    table = written(spark.range(3))
    folder = Path(table._cuelight_path.removeprefix("file:"))
    assert folder.exists() and table.count() == 3
    discard(table, spark.range(1))
    assert not folder.exists()
