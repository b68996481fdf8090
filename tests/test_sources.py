from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cuelight.sources import media
from cuelight.sources.jsonl import coerce_records, read_json_lines, read_record_segments, read_records, records_by_id
from cuelight.sources.subtitles import read_srt, srt_cues, stt_segments


def lines(tmp_path, *rows, bom=False):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def test_json_lines_skip_blanks_and_the_mark(spark, tmp_path):
    path = lines(tmp_path, {"a": 1}, "", "   ", {"a": "2.5", "more": [1]}, bom=True)
    rows = read_json_lines(spark, path).orderBy("position").select(F.to_json("v")).collect()
    assert [json.loads(r[0]) for r in rows] == [{"a": 1}, {"a": "2.5", "more": [1]}]


@pytest.mark.parametrize("bad", ["{", "[1]", "3"])
def test_a_bad_line_is_named(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="line 3"):
        read_json_lines(spark, lines(tmp_path, {"a": 1}, "", bad, "["))


def test_records(spark, tmp_path):
    path = lines(
        tmp_path,
        {"sample_id": "s/1", "sample_index": "7", "timestamp_points": [10, "20.5"], "qid": 3, "question": "This?", "transcript_text": "x", "video_name": "v"},
        {"sample_id": None, "has_timestamp": None, "raw_keys": ["k"]},
        {"sample_id": "s/1", "answer": "later", "has_timestamp": True},
    )
    a, b, c = read_records(spark, path).orderBy("position").collect()
    assert (a.sample_index, a.timestamp_points, a.has_timestamp, a.qid) == (7, [10.0, 20.5], True, "3")
    assert (b.sample_id, b.timestamp_points, b.has_timestamp, b.qid, b.raw_keys) == ("", [], False, None, ["k"])
    assert c.has_timestamp is True
    assert records_by_id(read_records(spark, path)).where("sample_id = 's/1'").first().answer == "later"
    assert read_records(spark, path, 0).count() == read_records(spark, path, -1).count() == 0
    assert read_records(spark, path, 2).count() == 2
    s = read_record_segments(spark, path).orderBy("position").first()
    assert (s.segment_id, s.start_time, s.end_time, s.timestamp_center, s.mention_candidates) == ("seg_s_1", 0.0, 105.25, 15.25, ["this"])


@pytest.mark.parametrize("row", ['{"timestamp_points": null}', '{"timestamp_points": ["x"]}', '{"sample_index": "x"}'])
def test_bad_records_raise(spark, row):
    rows = spark.createDataFrame([(row,)], "t string").select(F.parse_json("t").alias("v"))
    with pytest.raises(Exception, match="not a"):
        coerce_records(rows).collect()


def cues(spark, text):
    return [tuple(r)[1:] for r in srt_cues(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("seq_no").collect()]


def test_srt(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,500\n첫 번째 줄\n두 번째 줄\n\n2\n00:00:03,000 --> 00:00:04,000\n다음 자막\n"
    want = [(1, 1.0, 2.5, "첫 번째 줄 두 번째 줄"), (2, 3.0, 4.0, "다음 자막")]
    assert cues(spark, text) == want
    path = tmp_path / "a.srt"
    path.write_bytes(("﻿" + text.replace("\n", "\r\n")).encode())
    assert [tuple(r)[1:] for r in read_srt(spark, str(path)).orderBy("seq_no").collect()] == want


def test_srt_skips_and_numbers_densely(spark):
    text = "no timing here\n\n9\n00:00:01,000 --> 00:00:02,000\n\n \n5\n00:00:03.000-->00:00:04.000\nhi\n00:00:05,000 --> 00:00:06,000\n"
    assert cues(spark, text) == [(1, 3.0, 4.0, "hi 00:00:05,000 --> 00:00:06,000")]
    assert cues(spark, "") == []


def stt(spark, *results):
    df = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(results)], "path string, t string")
    rows = stt_segments(df.select("path", F.parse_json("t").alias("v")), F.col("v")).orderBy("path", "seq_no").collect()
    return [tuple(r)[1:] for r in rows]


def test_stt(spark):
    given = {"segments": [{"start": 1, "end": 2.5, "text": " 안녕하세요\n여러분 "}, {"start": 5, "end": 4, "text": "끝"}, {"start": 9, "end": 10, "text": "   "}]}
    assert stt(spark, given) == [(1, 1.0, 2.5, "안녕하세요 여러분"), (2, 5.0, 5.0, "끝")]
    assert stt(spark, {"text": "전체 transcript"}) == [(1, 0.0, 0.0, "전체 transcript")]
    assert stt(spark, {"segments": [{"start": "x", "text": "a"}, {"text": None}]}) == [(1, 0.0, 0.0, "a")]
    assert stt(spark, {}) == []


def test_probe(spark):
    printed = '{"streams": [{"width": "640", "height": 480.5, "r_frame_rate": "30/1"}], "format": {"duration": "12.5"}}'
    df = spark.createDataFrame([("a", printed), ("b", "{}")], "path string, value string")
    a, b = media.probe_rows(df).orderBy("path").collect()
    assert tuple(a) == ("a", 12.5, 640, 480, "30/1")
    assert tuple(b) == ("b", None, None, None, None)


def test_files_of_a_project(tmp_path):
    folder = tmp_path / "p"
    (folder / "segments").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        media.segment_file(folder)
    plain, aligned = folder / "segments" / "lecture_segments.jsonl", folder / "segments" / "lecture_segments_aligned.jsonl"
    plain.touch()
    assert media.segment_file(folder) == str(plain)
    aligned.touch()
    assert media.segment_file(folder) == str(aligned)
    assert media.project_folder(tmp_path, "p") == folder == media.project_folder(tmp_path, project_dir=folder)
    for wrong in ({}, {"project_id": "p", "project_dir": folder}):
        with pytest.raises(ValueError):
            media.project_folder(tmp_path, **wrong)
    with pytest.raises(FileNotFoundError):
        media.project_folder(tmp_path, "q")
    video = tmp_path / "v.mp4"
    video.touch()
    assert media.resolve_srt(video, None) is None
    (tmp_path / "v.srt").touch()
    assert media.resolve_srt(video, None) == str(tmp_path / "v.srt")
    with pytest.raises(FileNotFoundError):
        media.resolve_srt(video, tmp_path / "none.srt")
    assert media.register_source(video, tmp_path / "s", False).is_symlink()
    assert media.register_source(video, tmp_path / "t", True).is_file()


def test_settings(tmp_path, monkeypatch):
    file = tmp_path / ".env"
    file.write_text('# note\nLANG_X="en"\nOTHER=value\n')
    monkeypatch.delenv("LANG_X", raising=False)
    assert media.setting("LANG_X", file) == "en"
    monkeypatch.setenv("LANG_X", "  ")
    assert media.setting("LANG_X", file) is None
    monkeypatch.setenv("LANG_X", " ko ")
    assert media.setting("LANG_X", file) == "ko"
    assert media.clean_setting("  ") is None
    assert media.setting("NOPE", tmp_path / "missing") is None


def test_missing_tools():
    with pytest.raises(RuntimeError, match="cannot be started"):
        media.run(["no-such-tool-here"])
    with pytest.raises(RuntimeError, match="ended with 1"):
        media.run(["false"])
    with pytest.raises(RuntimeError, match="speech"):
        media.transcribe("a.wav")
