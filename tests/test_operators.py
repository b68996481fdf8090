from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cuelight.operators import evaluation, intervals, numbering, search, segments


def seg(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, segment_id string, start_time double, end_time double")


def fr(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, frame_id string, timestamp double")


def refs(df):
    return [r.frame_refs for r in df.orderBy("ordinal").collect()]


@pytest.mark.parametrize("ranged", [True, False])
def test_align(spark, ranged):
    s = seg(spark, ("seg_1", 10.0, 12.0), ("seg_2", 30.0, 31.0))
    f = fr(spark, ("f1", 9.8), ("f2", 10.0), ("f3", 11.5), ("f4", 12.2), ("f5", 30.49))
    out = intervals.align(s, f, 0.5, ranged)
    assert refs(out) == [["f1", "f2", "f3", "f4"], ["f5"]]
    assert out.columns == [*s.columns, "frame_refs"]
    assert tuple(intervals.align_summary(out, 0.5).first()) == (0.5, 2, 2, 0, 5, 5)


@pytest.mark.parametrize("ranged", [True, False])
def test_align_at_the_ends_and_without_frames(spark, ranged):
    f = fr(spark, ("s", 5.0), ("e", 7.0), ("b", 4.999), ("a", 7.001), ("n", None), ("x", float("nan")))
    assert refs(intervals.align(seg(spark, ("q", 5.0, 7.0)), f, -3.0, ranged)) == [["s", "e"]]
    none = intervals.align(seg(spark, ("q", 1.0, 2.0)), fr(spark).limit(0), 0.0, ranged)
    assert refs(none) == [[]]
    assert tuple(intervals.align_summary(none).first())[1:] == (1, 0, 1, 0, 0)
    assert refs(intervals.align(seg(spark).limit(0), f, 0.0, ranged)) == []


@pytest.mark.parametrize("ranged", [True, False])
def test_windows(spark, ranged):
    nan = float("nan")
    s = seg(spark, ("a", None, 5.0), ("b", 5.0, None), ("c", None, None), ("d", 6.0, 4.0), ("a", nan, 9.0), ("e", 0.0, nan))
    f = fr(spark, ("p", 5.0), ("p", 5.0), (None, 5.0))
    assert refs(intervals.align(s, f, 0.0, ranged)) == [["p", "p", ""]] * 2 + [[]] + [["p", "p", ""]] + [[], []]


def test_frame_without_id_takes_the_stem(spark):
    f = spark.createDataFrame([(None, "/x/a.b.jpg"), ("", ".hidden"), ("id", "x")], "frame_id string, frame_path string")
    assert [r.point_id for r in intervals.frame_points(f).collect()] == ["a.b", ".hidden", "id"]


@pytest.mark.parametrize("points", [100_000, 20, 3])
def test_ranged_join_is_the_plain_one(spark, monkeypatch, points):
    """One range, many, and ranges that are split since half of the points share a time."""
    monkeypatch.setattr(intervals, "_RANGE_POINTS", points)
    rng = random.Random(3)
    spans = [(rng.choice([0.0, 1e-9, 0.5, 3.0, 1000.0, 1e7]), rng.uniform(-500, 500)) for _ in range(200)]
    s = seg(spark, *((f"s{i}", a, a + w) for i, (w, a) in enumerate(spans)), ("inf", -math.inf, math.inf), ("far", 1e300, 1e301))
    f = fr(spark, *((f"f{i}", rng.choice([rng.uniform(-600, 600), float(rng.randint(-50, 50)), 7.0, 7.0])) for i in range(500)), ("far", 2e300), ("i", math.inf))
    assert refs(intervals.align(s, f, 0.25)) == refs(intervals.align(s, f, 0.25, ranged=False))


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_distinct_frames_by_bitmaps(spark, monkeypatch, sent):
    """Names that repeat count once; ordinals over several bitmaps."""
    monkeypatch.setattr(intervals, "_BITS_SENT", sent)
    rng = random.Random(5)
    f = spark.createDataFrame([(f"f{rng.randrange(40)}", float(rng.randrange(200)), rng.randrange(200_000)) for _ in range(300)], "frame_id string, timestamp double, ordinal long")
    f = f.dropDuplicates(["ordinal"])
    s = seg(spark, *((f"s{i}", a, a + 3.0) for i, a in enumerate(map(float, rng.choices(range(150), k=20)))))
    by_names = tuple(intervals.align_summary(intervals.align(s, f, 0.5), 0.5).first())
    assert tuple(intervals.align_summary(intervals.align(s, f, 0.5, numbers="n"), 0.5, f, "n").first()) == by_names and by_names[5] > 10


def test_cue_segments(spark):
    cue = spark.createDataFrame([(3, 1.0, 2.0, "This LINE")], "seq_no long, start_time double, end_time double, text string")
    row = segments.cue_segments(cue, "p", "my video").first()
    assert (row.segment_id, row.sample_id, row.timestamp_points, row.normalized_text) == ("seg_my_video_000003", "seg_my_video_000003", [1.5], "this line")
    assert (row.dataset_name, row.subset_name, row.split_name, row.source, row.slide_id) == ("local_video", "pilot", "ingest", "srt", None)
    assert row.mention_candidates == ["this", "line"]


def question(spark, points):
    return spark.createDataFrame([(1, points)], "query_id long, timestamp_points array<double>")


def candidate(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, rank int, sample_id string, video_id string, timestamp_center double")


def test_any_gold_point_may_match(spark):
    out = evaluation.evaluate(question(spark, [100.0, 150.0]), candidate(spark, (1, 1, "other", "v", 107.0)), [5, 10])
    row = out.first()
    assert (row.best_abs_error, row.hit_by_delta, row.top_candidate_sample_id) == (7.0, {5: False, 10: True}, "other")
    assert tuple(evaluation.summarize(out, [5, 10]).first()) == (1, 7.0, 0.0, 1.0)


@pytest.mark.parametrize("points, center", [([], 1.0), ([1.0], None)])
def test_no_pair(spark, points, center):
    out = evaluation.evaluate(question(spark, points), candidate(spark, (1, 1, "a", "v", center)), [5, 5])
    assert (out.first().best_abs_error, out.first().hit_by_delta) == (None, {5: False})
    assert tuple(evaluation.summarize(out, [5]).first()) == (1, None, 0.0)


def test_summary_of_nothing(spark):
    out = evaluation.evaluate(question(spark, [1.0]).limit(0), candidate(spark, (1, 1, "a", "v", 1.0)), [5])
    assert evaluation.as_summary(evaluation.summarize(out, [5]).first()) == {"count": 0}


def test_rates_are_of_all_questions(spark):
    asked = spark.createDataFrame([(1, [1.0]), (2, []), (3, [50.0])], "query_id long, timestamp_points array<double>")
    out = evaluation.evaluate(asked, candidate(spark, (1, 1, "a", "v", 2.0), (3, 1, "b", "v", 80.0)), [5])
    assert tuple(evaluation.summarize(out, [5]).first()) == (3, 15.5, 0.3333)


def test_same_video(spark):
    asked = spark.createDataFrame([(1, [1.0], "w")], "query_id long, timestamp_points array<double>, video_name string")
    got = candidate(spark, (1, 1, "a", "v", 1.0), (1, 2, "b", "w", 9.0))
    assert evaluation.evaluate(asked, got, [5]).first().best_abs_error == 0.0
    assert evaluation.evaluate(asked, got, [5], same_video=True).first().best_abs_error == 8.0


def test_search(spark):
    docs = spark.createDataFrame(
        [("a", "red fox", "v1"), ("b", "red red dog", "v2"), ("c", "cat", "v1"), ("d", None, "v1")], "segment_id string, transcript_text string, video_name string"
    )
    index = search.build_index(docs)
    ask = spark.createDataFrame([(1, "RED!"), (2, "fox cat"), (3, "zebra"), (4, None)], "query_id long, query string")
    got = [(r.query_id, r.rank, r.key) for r in search.search(index, ask, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c"), (2, 2, "a")]
    assert search.search(index, ask, 0).count() == 0
    shown = search.candidates(index, ask, 1, where="video_name = 'v1'").orderBy("query_id").first()
    assert (shown.segment_id, shown.video_id, shown.transcript_excerpt, shown.start_time) == ("a", "v1", "red fox", None)


def test_numbering(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    out = numbering.numbered(rows, "id")
    assert out.where("ordinal <> id").count() == 0 and out.count() == 1000
    assert numbering.prefix(out, 0).count() == numbering.prefix(out, -1).count() == 0
    assert numbering.prefix(out, None).count() == 1000
    sizes = {r.batch: r["count"] for r in numbering.batched(out, 300).groupBy("batch").count().collect()}
    assert sizes == {0: 300, 1: 300, 2: 300, 3: 100}
    with pytest.raises(ValueError):
        numbering.batched(out, 0)
    assert numbering.numbered(rows.limit(0), "id").count() == 0


def test_upsert(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 3, "n"), (None, 4, "m")], "k string, v int, w string")
    assert {tuple(r) for r in numbering.upsert(a, b, "k").collect()} == {("x", 1, None), ("y", 3, "n"), (None, 4, "m")}
