from __future__ import annotations

import math
import re
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelight.functions import scalars as S


def apply(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_slugify(spark):
    given_ = [" a b ", "ünï", "__x__", "a.b:c-d_e", "", "안녕", "a//b"]
    assert apply(spark, given_, S.slugify) == ["a_b", "n", "x", "a.b:c-d_e", "empty", "empty", "a_b"]


def test_mentions_are_substrings_in_list_order(spark):
    got = apply(spark, ["Here in the THERE, hundred", "배트 사이즈는 복잡합니다.", "이 부분을 보세요.", None], S.mention_candidates)
    assert got[0] == ["here", "red"]
    assert "이것" not in got[1]
    assert got[2] == ["이 부분"]
    assert got[3] == []


@pytest.mark.parametrize("n", [0, 359, 360, 361])
def test_excerpt(spark, n):
    text = "😀" * n
    assert apply(spark, [text], S.excerpt) == [text if n <= 360 else text[:360] + "..."]


def test_path_stem_is_that_of_the_library(spark):
    paths = ["/x/a.b.jpg", ".hidden", "a.", "x/y/", "plain", "/x/.hidden.txt", "", "a/b.c/d", "..b"]
    assert apply(spark, paths, S.path_stem) == [PurePosixPath(p).stem for p in paths]
    assert apply(spark, [None], S.path_stem) == [""]


def as_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_parse_double(spark):
    texts = ["1", " 2.5 ", "1d", "1f", "1_000", "1__0", "", "abc", "-inf", "nan", "1e5", ".5", "5.", "+3", "0x1", " 7 "]
    for got, want in zip(apply(spark, texts, S.parse_double), map(as_float, texts), strict=True):
        assert got == want or (got != got and want != want)


def test_parse_long(spark):
    assert apply(spark, ["12", " 12 ", "1.5", "1_0", "", "x", "-3"], S.parse_long) == [12, 12, None, 10, None, None, -3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=200, max_size=200))
def test_rounded_is_half_even_on_the_binary_value(spark, xs):
    got = apply(spark, xs, lambda c: S.rounded(c, 4), "double")
    assert [(g, x) for g, x in zip(got, xs, strict=True) if g != round(x, 4)] == []


def test_rounding_of_halves(spark):
    """Halves of the last place, as texts have them and one unit of the binary value beside, and numbers of any size."""
    halves = [sign * (n + 0.5) / 10**4 for n in range(400) for sign in (1, -1)]
    xs = [y for x in halves for y in (x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf))]
    xs += [5e-5, -5e-5, 0.0, -0.0, 1e15, 4.5e15, 1e300, -1e300, 2.5, 0.00015, math.inf, -math.inf, 1234567890123.00005, 5e-324]
    got = apply(spark, xs, lambda c: S.rounded(c, 4), "double")
    assert [(g, x) for g, x in zip(got, xs, strict=True) if repr(g) != repr(x if math.isinf(x) else round(x, 4))] == []
    assert math.isnan(apply(spark, [math.nan], lambda c: S.rounded(c, 4), "double")[0]) and apply(spark, [None], lambda c: S.rounded(c, 4), "double") == [None]


@pytest.mark.parametrize("fps", [3, 29.97, 1.0, 80, 400, 0.3])
def test_frame_times(spark, fps):
    got = [r[0] for r in spark.range(1, 2001).orderBy("id").select(S.frame_time(F.col("id"), fps)).collect()]
    assert got == [round((i - 1) / fps, 3) for i in range(1, 2001)]


def test_frame_time_without_rate(spark):
    assert spark.range(1, 2).select(S.frame_time(F.col("id"), 0)).first()[0] is None


def test_frame_names_widen(spark):
    assert apply(spark, [7, 1234567], S.frame_name, "long") == ["frame_000007", "frame_1234567"]


def test_subtitle_seconds(spark):
    assert apply(spark, ["00:01:02,500", "01:00:00.000"], S.subtitle_seconds) == [62.5, 3600.0]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(" \t\n\x0b\x1c\x1f\x85  　ab", max_size=12), min_size=20, max_size=20))
def test_collapse_space(spark, texts):
    assert apply(spark, texts, S.collapse_space) == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_mean(spark):
    got = apply(spark, [[1.0, 2.0], [], [5.0]], S.mean, "array<double>")
    assert got == [1.5, None, 5.0]


def test_deltas(spark):
    assert S.parse_deltas("5,,10") == [5, 10]
    assert apply(spark, ["5,, 10"], S.delta_list) == [[5, 10]]
    with pytest.raises(ValueError):
        S.parse_deltas(" , ")
    with pytest.raises(Exception, match="delta"):
        apply(spark, [""], S.delta_list)


def test_variant_numbers(spark):
    texts = ['{"x": true}', '{"x": "2.5"}', '{"x": 3}', '{"x": 1.9}', '{"x": -1.9}', '{"x": null}', "{}", '{"x": []}', '{"x": "1.5"}', '{"x": "q"}']
    value = lambda c: F.try_variant_get(F.parse_json(c), "$.x", "variant")
    assert apply(spark, texts, lambda c: S.variant_double(value(c))) == [1.0, 2.5, 3.0, 1.9, -1.9, None, None, None, 1.5, None]
    assert apply(spark, texts, lambda c: S.variant_long(value(c))) == [1, None, 3, 1, -1, None, None, None, None, None]


def test_sources(spark):
    df = spark.createDataFrame([("auto", "x"), ("auto", None), ("none", "x"), ("srt", None)], "r string, p string")
    got = [r[0] for r in df.select(S.transcript_source(F.col("r"), F.col("p"))).collect()]
    assert got == ["srt", "stt", "none", "srt"]
