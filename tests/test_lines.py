from __future__ import annotations

import bz2
import gzip
import io
import json

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from cuelight.operators import intervals, numbering
from cuelight.sources import jsonl, lines, subtitles


def python_lines(data):
    return [line.rstrip("\n") for line in io.TextIOWrapper(io.BytesIO(data), encoding="utf-8-sig")]


@given(st.lists(st.sampled_from([b"\n", b"\r", b"\r\n", b"a", b"bc", b" ", " é".encode(), b"\x0b"]), max_size=30), st.integers(1, 9), st.booleans())
@example([b"\r", b"\n"], 1, False)
@settings(max_examples=300, deadline=None)
def test_ranges_cut_lines_as_python_reads_them(tmp_path_factory, parts, size, mark):
    """Every size of range and of piece, any line ends, with and without a byte order mark."""
    lines._CHUNK = max(1, size // 2)
    data = (b"\xef\xbb\xbf" if mark else b"") + b"".join(parts)
    path = tmp_path_factory.mktemp("x") / "f"
    path.write_bytes(data)
    want = python_lines(data)
    total, got = 0, []
    for r in lines._cut([(f"file:{path}", len(data))], size):
        for n, rows, own in lines.pieces_of(r):
            got += [(total + i, line.decode()) for i, line in zip(rows, own, strict=True)]
            total += n
    lines._CHUNK = 1 << 20
    assert total == len(want)
    assert got == [(i, line) for i, line in enumerate(want) if line.strip()]


@given(st.lists(st.sampled_from([b"\n", b"\r", b"\r\n", b"a", b"bc", b" ", b"\x0b"]), max_size=30), st.integers(1, 9), st.booleans(), st.sampled_from(["gz", "bz2"]))
@settings(max_examples=100, deadline=None)
def test_compressed_files_are_streams(tmp_path_factory, parts, size, mark, kind):
    """In one range, of two members, whatever the pieces; Arrow reaches them, so their lines are not sorted to be numbered."""
    pack = {"gz": gzip.compress, "bz2": bz2.compress}[kind]
    data = (b"\xef\xbb\xbf" if mark else b"") + b"".join(parts)
    path = tmp_path_factory.mktemp("x") / f"f.{kind}"
    path.write_bytes(pack(data[:7]) + pack(data[7:]))
    files = [(f"file:{path}", path.stat().st_size)]
    (own,) = lines._cut(files, size)
    assert lines._reachable(files)
    lines._CHUNK = size
    total, got = 0, []
    for n, rows, found in lines.pieces_of(own):
        got += [(total + i, line.decode()) for i, line in zip(rows, found, strict=True)]
        total += n
    lines._CHUNK = 1 << 20
    want = python_lines(data)
    assert total == len(want) and got == [(i, line) for i, line in enumerate(want) if line.strip()]


@pytest.fixture(params=["ranges", "text reader"])
def reader(request, monkeypatch):
    if request.param == "text reader":
        monkeypatch.setattr(lines, "_reachable", lambda files: False)
    return request.param


@pytest.fixture
def small(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_and_limits_over_many_ranges(spark, tmp_path, reader, small):
    rows = [{"i": i, "pad": "x" * (i % 40)} for i in range(120)]
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        text = "".join(json.dumps(r) + "\n" * (1 + r["i"] % 3) for r in rows[part * 40 : part * 40 + 40])
        (folder / f"part-{part}.jsonl").write_text(text)
    (folder / "_hidden").write_text("[]")
    path = str(folder)
    read = jsonl.read_json_lines(spark, path)
    got = sorted((r.ordinal, json.loads(r.v.toJson())["i"]) for r in lines.in_order(read.withColumn("ordinal", read.position.row)).collect())
    assert got == [(i, i) for i in range(120)]
    want, at = [], 0
    for r in rows:
        at = 0 if r["i"] % 40 == 0 else at
        want.append(at + 1)
        at += 1 + r["i"] % 3
    numbers = lines.with_line_numbers(read, path).orderBy("position").collect()
    assert [r.line_number for r in numbers] == want
    for limit in (0, -1, 1, 41, 119, 500):
        rows_ = jsonl.read_json_lines(spark, path, limit=limit).orderBy("position").collect()
        assert [json.loads(r.v.toJson())["i"] for r in rows_] == list(range(120))[: max(0, limit)]


def test_a_limit_stops_before_a_bad_line(spark, tmp_path, reader):
    path = tmp_path / "f.jsonl"
    path.write_text('{"sample_id": 1}\n\n{"sample_id": 2}\n[3]\n{"sample_id": 4}')
    assert [r.sample_id for r in jsonl.read_records(spark, str(path), 2).orderBy("position").collect()] == ["1", "2"]
    for limit in (3, None):
        with pytest.raises(ValueError, match=r"f\.jsonl, line 4: not a JSON object: \[3\]"):
            jsonl.read_records(spark, str(path), limit)
    with pytest.raises(FileNotFoundError):
        jsonl.read_records(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "empty.jsonl").write_text("")
    assert jsonl.read_records(spark, str(tmp_path / "empty.jsonl")).collect() == []


@pytest.mark.parametrize("size", ["7", "128m"])
def test_subtitles_by_ranges_are_those_of_the_whole_text(spark, tmp_path, reader, size):
    """Blocks cut anywhere, lines longer than a range, blank lines of white space, defective blocks, several files."""
    stamp = "00:00:01,000 --> 00:00:02.500"
    texts = ["\ufeff1\r\n" + stamp + "\r\nhello\r\nworld\r\n\r\n2\n" + stamp + "\n\n\n  \n3\nno timing\n\nbefore\n" + stamp + " x\nlast é" + "y" * 90 + "\x0bpart",
             "", stamp + "\none", "\n\n" + stamp + "\ra\r\rb\r" + stamp + "\rc\n\t\n" + stamp + "\nd"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.srt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = sorted((r.path.rpartition("/")[2], *r[1:]) for r in subtitles.read_srt(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.createDataFrame([(f"{i}.srt", t) for i, t in enumerate(texts)], "path string, value string")
    assert got == sorted(map(tuple, subtitles.srt_cues(whole).collect())) and len(got) == 6


def test_a_limit_reads_no_further_ranges(spark, tmp_path, small):
    path = tmp_path / "f.jsonl"
    path.write_text("".join(json.dumps({"i": i}) + "\n" for i in range(1000)))
    ranges = lines._cut(lines._files(spark, str(path)), 64)
    kept = lines._prefix(spark, ranges, 10, 64)
    assert len(ranges) > 100 and [r.start for r in kept] == [0, 64] and sum(r.take for r in kept) == 10


KINDS = ["true", "false", "null", "1e5", "-2.50", "0.1", "1e22", "1e-7", "0.0001", "123456789012345680000", "0.0", "2.0", "3", '"x"', '""', "[]", "[0]", "{}", '{"a": 1}', "1e16", "123456789.123"]


def test_kinds_are_as_python_has_them(spark):
    """Texts and truth of JSON values; lists and objects as texts are JSON here."""
    made = spark.createDataFrame([(i, f'{{"question": {k}, "has_timestamp": {k}}}') for i, k in enumerate(KINDS)], "i int, text string").selectExpr("i", "parse_json(text) v")
    rows = {r.i: r for r in jsonl.coerce_records(made, ["i"]).collect()}
    strict = {r.i: r for r in jsonl.coerce_records(made, ["i"], null_text="None").collect()}
    for i, k in enumerate(KINDS):
        value = json.loads(k)
        assert rows[i].has_timestamp == bool(value), k
        if not isinstance(value, list | dict):
            assert strict[i].question == str(value), k
            assert rows[i].question == ("" if value is None else str(value))


def test_columns_of_any_name(spark):
    """Names that plans use for themselves, and those of results."""
    df = spark.createDataFrame([(10, 7, 1, "a", 0), (20, 8, 2, "b", 1), (30, 9, 3, "c", 2)], "_part int, _at int, _held int, key string, ordinal long")
    got = numbering.numbered(df, "key")
    assert got.columns == ["_part", "_at", "_held", "key", "ordinal"] and sorted(map(tuple, got.collect()))[1] == (20, 8, 2, "b", 1)
    named = spark.createDataFrame([("k", 1, "x", 5), ("k", 2, "y", 6)], "key string, _nth int, _new string, nth int")
    assert [tuple(r) for r in numbering.last_wins(named, "key", "_nth").collect()] == [("k", 2, "y", 6)]
    assert [tuple(r) for r in numbering.upsert(named.where("_nth = 2"), named.where("_nth = 1").drop("nth"), "key").collect()] == [("k", 1, "x", None)]
    segments = spark.createDataFrame([(0, 1.0, 3.0, "k", ["r"], "z")], "ordinal long, start_time double, end_time double, _key string, _refs array<string>, window string")
    frames = spark.createDataFrame([("f", 2.0, 0)], "frame_id string, timestamp double, ordinal long")
    assert tuple(intervals.align(segments, frames).first()) == (0, 1.0, 3.0, "k", ["r"], "z", ["f"])
