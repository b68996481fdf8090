"""Queries over the test tables that exercise each operator, with the same in DuckDB's SQL.

Records come from ``documents``, questions from ``benchmark``, cues from ``conversations``, windows and frames from ``events``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions import scalars as S
from cuelight.operators import evaluation, intervals, numbering, search, segments
from cuelight.plans import workflows
from cuelight.scratch import Folder, shared_folder
from cuelight.session import ship, spread
from cuelight.sinks import files
from cuelight.sinks.index_store import IndexStore
from cuelight.sources import jsonl, lines, media, subtitles

DELTAS = (60, 300, 900)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(ship(spark))}/cuelight-{name}-{uuid.uuid4().hex}"


def _points(key: str) -> Column:
    a, b = ((F.col(key) * n % 3600).cast("double") for n in (37, 53))
    return F.when(F.col(key) % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(a, b))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.lit("corpus").alias("dataset_name"), F.lit("all").alias("subset_name"), F.lit("test").alias("split_name"),
        F.col("doc_id").alias("sample_index"), F.concat_ws("/", "source", "doc_id").alias("sample_id"), F.col("source").alias("video_name"),
        F.col("text").alias("question"), F.lit("").alias("answer"), F.col("text").alias("transcript_text"),
        _points("doc_id").alias("timestamp_points"), (F.col("doc_id") % 5 != 0).alias("has_timestamp"),
        F.lit(None).cast("string").alias("qid"), F.array(F.lit("text")).alias("raw_keys"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").alias("query")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text, _points("item_id").alias("timestamp_points"))


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", seconds.alias("at"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with some time around them; in these queries windows are purchases, frames are clicks, and events of other types neither."""
    bought = _events(spark, sf_dir, "purchase")
    half = (F.col("event_id") % 7 * 30).cast("double")
    return bought.select(F.col("event_id").alias("ordinal"), (F.col("at") - half).alias("start_time"), (F.col("at") + half).alias("end_time"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").select(
        F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("frame_id"), F.col("at").alias("timestamp")
    )


def _index(spark: SparkSession, sf_dir: str) -> search.TextIndex:
    rows = segments.record_segments(records(spark, sf_dir)).withColumn("doc", F.col("sample_index"))
    return search.build_index(rows, "doc", vocabulary=search.terms_of(questions(spark, sf_dir)))


def mention_candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.mention_candidates(F.col("text")), "|").alias("mentions"))


def slugify(spark, sf_dir):
    """Slugs of whole texts, by their MD5."""
    slug = S.slugify(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(slug).alias("slug_md5"), F.char_length(slug).cast("long").alias("slug_chars"))


def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.excerpt(F.col("text")).alias("excerpt"))


def text_functions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", S.collapse_space(F.col("html")).alias("collapsed"), S.path_stem(F.col("url")).alias("stem"), S.video_id(F.col("url")).alias("video_id")
    )


def number_functions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "))).otherwise(
        F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 1, "x").otherwise(""))
    )
    return lines.groupBy("l_linenumber").agg(
        F.count(S.parse_double(text)).alias("doubles"), F.sum(S.parse_double(text)).alias("total"), F.count(S.parse_long(text)).alias("longs")
    )


def transcript_source(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, ("auto", "none", "srt", "stt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".srt")))
    return table(spark, sf_dir, "documents").select("doc_id", S.transcript_source(asked, path).alias("transcript_source"))


def record_coerce(spark, sf_dir):
    """Records written as JSON with texts for numbers, missing keys and nulls, and read back; whole texts by their MD5."""
    docs = table(spark, sf_dir, "documents")
    points = F.transform(_points("doc_id"), lambda p: p.cast("string"))
    row = F.struct(
        F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("sample_index"),
        F.concat_ws("/", "source", "doc_id").alias("sample_id"), F.col("text").alias("question"), F.col("text").alias("transcript_text"),
        points.alias("timestamp_points"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("qid"),
    )
    made = jsonl.coerce_records(docs.select(F.parse_json(F.to_json(row)).alias("v")))
    return made.select(
        "sample_index", "sample_id", "video_name", F.md5("question").alias("question_md5"), F.md5("transcript_text").alias("transcript_md5"), "answer",
        F.size("timestamp_points").cast("long").alias("n_points"), "has_timestamp", "qid",
    )


def jsonl_scan(spark, sf_dir):
    """Documents written as JSON lines and read back as open rows, keys in any order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"))
    path = scratch_path(spark, "lines")
    files.write_lines(docs.withColumn("at", F.col("doc_id")), path, "at")
    v = F.col("v")
    rows = jsonl.read_json_lines(spark, path)
    return rows.select(
        F.try_variant_get(v, "$.doc_id", "long").alias("doc_id"), F.md5(F.try_variant_get(v, "$.text", "string")).alias("text_md5"),
        jsonl.text_field(v, "lang", "missing").alias("lang"), F.is_variant_null(jsonl.field(v, "lang")).alias("is_null"),
    )


def records_by_id(spark, sf_dir):
    """Records by a key that repeats: the last of each."""
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("sample_id"), "doc_id")
    return jsonl.records_by_id(rows.withColumn("position", F.struct(F.lit("f").alias("file"), F.lit(0).alias("block"), F.col("doc_id").alias("row")))).drop("position")


def index_documents(spark, sf_dir):
    """Segments added to a stored index in two overlapping batches, the second with other texts."""
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    store.create_index("i")
    store.update_settings("i")
    rows = segments.record_segments(records(spark, sf_dir))
    store.add_documents("i", rows.where("sample_index % 3 <> 1"))
    store.add_documents("i", rows.where("sample_index % 3 <> 0").withColumn("video_name", F.lit("second")))
    return store.documents("i").select("segment_id", "sample_index", "video_name")


def eval_rows(spark, sf_dir):
    """What an evaluation writes for each question, candidates in order."""
    asked = questions(spark, sf_dir)
    found = search.candidates(_index(spark, sf_dir), asked, 5)
    rows = evaluation.with_candidates(evaluation.evaluate(asked, found, DELTAS), found)
    listed = F.array_join(F.transform("topk_candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c.sample_id)), ",")
    return rows.select("query_id", F.size("timestamp_points").cast("long").alias("n_points"), F.size("topk_candidates").cast("long").alias("n_candidates"), listed.alias("candidates"))


def time_and_delta_functions(spark, sf_dir):
    """Subtitle stamps to seconds, and lists of deltas, made from ids."""
    n = F.col("doc_id")
    stamp = F.format_string("%02d:%02d:%02d,%03d", n % 24, n % 60, n * 7 % 60, n * 13 % 1000)
    deltas = S.delta_list(F.concat_ws(",", n.cast("string"), F.lit(" "), (n + 1).cast("string"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", S.subtitle_seconds(stamp).alias("seconds"), F.array_join(deltas.cast("array<string>"), "|").alias("deltas"))


def variant_numbers(spark, sf_dir):
    """Numbers as JSON has them in events' props, null on bad, and some as texts or booleans."""
    n = F.col("event_id")
    made = F.when(n % 4 == 0, F.concat(F.lit('{"x": '), n.cast("string"), F.lit("}"))).when(n % 4 == 1, F.concat(F.lit('{"x": "'), n.cast("string"), F.lit('.5"}')))
    made = F.parse_json(made.when(n % 4 == 2, '{"x": true}').otherwise('{"x": "none"}'))
    value = F.try_variant_get(made, "$.x", "variant")
    return table(spark, sf_dir, "events").select("event_id", S.variant_double(value).alias("as_double"), S.variant_long(value).alias("as_long"))


def record_segments(spark, sf_dir):
    made = segments.record_segments(records(spark, sf_dir))
    return made.select(
        "segment_id", "sample_index", "video_id", "start_time", "end_time", "timestamp_center", F.array_join("mention_candidates", "|").alias("mentions"), "source"
    )


def _cues(spark, sf_dir) -> DataFrame:
    said = S.collapse_space(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))


def srt_roundtrip(spark, sf_dir):
    """Conversations written as subtitle files and read back."""
    stamp = lambda s: F.concat(F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s / 60 % 60).cast("int"), (s % 60).cast("int")), F.lit(",000"))
    start = F.col("turn") * 10
    block = F.concat(F.col("turn").cast("string"), F.lit("\r\n"), stamp(start), F.lit(" --> "), stamp(start + 8), F.lit("\r\n"), F.col("said"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("block")))), lambda b: b.block)
    files = _cues(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.lit("﻿"), F.array_join(lines, "\r\n\r\n")).alias("value"))
    return subtitles.srt_cues(files.withColumnRenamed("conv_id", "path")).withColumnRenamed("path", "conv_id")


def srt_large_files(spark, sf_dir):
    """Documents as the cues of large subtitle files, read back by ranges of bytes. Every seventh block has no timing, every eleventh no text, every
    thirteenth something before its timing; numbers go on through the files."""
    n, text = F.col("doc_id"), S.collapse_space(F.col("text"))
    stamp = lambda more: F.format_string("%02d:%02d:%02d,%03d", n % 24, n % 60, (n * 7 + more) % 60, n % 1000)
    timing = F.when(n % 7 == 0, "no timing").otherwise(F.concat(F.when(n % 13 == 0, "before\n").otherwise(""), stamp(0), F.lit(" --> "), stamp(1)))
    block = F.concat(n.cast("string"), F.lit("\r\n"), timing, F.lit("\n"), F.when(n % 11 != 0, text).otherwise(" "), F.lit("\n \n"))
    path = scratch_path(spark, "srt")
    files.write_lines(table(spark, sf_dir, "documents").select("doc_id", block.alias("line")), path, "doc_id", F.col("line"))
    cues = subtitles.read_srt(spark, path)
    counts = cues.groupBy("path").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    bases = counts.select("path", F.coalesce(earlier, F.lit(0)).alias("base"))
    return cues.join(bases, "path").select((F.col("base") + F.col("seq_no")).alias("seq_no"), "start_time", "end_time", F.md5("text").alias("text_md5"))


def cue_segments(spark, sf_dir):
    cues = _cues(spark, sf_dir).select(
        (F.col("turn") + 1).alias("seq_no"), (F.col("turn") * 10).cast("double").alias("start_time"), (F.col("turn") * 10 + 8).cast("double").alias("end_time"),
        F.col("said").alias("text"), "conv_id",
    )
    made = segments.cue_segments(cues, "demo", F.concat(F.lit("conv "), F.col("conv_id").cast("string")))
    return made.select("segment_id", "sample_index", "start_time", "end_time", "timestamp_center", "normalized_text", "split_name")


def stt_normalize(spark, sf_dir):
    """Conversations as speech-to-text results, with ends before starts and blank segments, read back."""
    rows = table(spark, sf_dir, "conversations")
    segment = F.struct(
        (F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + F.when(F.col("turn") % 2 == 0, 5).otherwise(-5)).cast("double").alias("end"),
        F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("text"))).alias("text"),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x.s)
    results = rows.groupBy("conv_id").agg(F.parse_json(F.to_json(F.struct(listed.alias("segments")))).alias("v"))
    return subtitles.stt_segments(results, F.col("v"), "conv_id")


def frame_grid(spark, sf_dir):
    grid = media.frame_grid(ship(spark), "frames", 29.97, table(spark, sf_dir, "benchmark").count())
    return grid.select("frame_id", "frame_path", "timestamp")


def frame_grid_rates(spark, sf_dir):
    """Grids at rates whose times often lie in the middle of two thousandths, all but for the binary value."""
    count = table(spark, sf_dir, "documents").count()
    grids = [media.frame_grid(ship(spark), "frames", fps, count).select(F.lit(fps).alias("fps"), "frame_id", "timestamp") for fps in (29.97, 80.0, 400.0)]
    return grids[0].unionByName(grids[1]).unionByName(grids[2])


def rounding(spark, sf_dir):
    """Means to four places, half a unit among them."""
    n = F.col("doc_id").cast("double")
    values = F.array(n / 80, n / 400, n / 20000, -n / 7, n * 0.00005)
    return table(spark, sf_dir, "documents").select("doc_id", *(S.rounded(values[i], 4).alias(f"r{i}") for i in range(5)))


def segment_window(spark, sf_dir):
    ends = windows(spark, sf_dir).select(
        "ordinal",
        F.when(F.col("ordinal") % 4 != 1, F.col("start_time")).alias("a"),
        F.when(F.col("ordinal") % 4 != 2, F.when(F.col("ordinal") % 8 == 0, F.col("start_time") - 5).otherwise(F.col("end_time"))).alias("b"),
    )
    window = intervals.segment_window(F.col("a"), F.col("b"), 0.5)
    return ends.select("ordinal", window.lo.alias("lo"), window.hi.alias("hi"))


def _refs(aligned: DataFrame) -> DataFrame:
    return aligned.select("ordinal", F.size("frame_refs").cast("long").alias("n_refs"), F.array_join("frame_refs", ",").alias("refs"))


def interval_align(spark, sf_dir):
    return _refs(intervals.align(windows(spark, sf_dir), frames(spark, sf_dir), 2.0))


def align_summary(spark, sf_dir):
    points = frames(spark, sf_dir)
    return intervals.align_summary(intervals.align(windows(spark, sf_dir), points, 2.0, numbers="frame_ordinals"), 2.0, points)


def search_topk(spark, sf_dir):
    found = search.search(_index(spark, sf_dir), questions(spark, sf_dir), 5)
    return found.select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def search_candidates(spark, sf_dir):
    found = search.candidates(_index(spark, sf_dir), questions(spark, sf_dir), 5)
    return found.select("query_id", "rank", "segment_id", "video_id", "timestamp_center", F.md5("transcript_excerpt").alias("excerpt_md5"))


def abs_errors(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return evaluation.absolute_errors(asked, search.candidates(_index(spark, sf_dir), asked, 5))


def _evaluated(spark, sf_dir) -> DataFrame:
    asked = questions(spark, sf_dir)
    return evaluation.evaluate(asked, search.candidates(_index(spark, sf_dir), asked, 5), DELTAS)


def eval_per_query(spark, sf_dir):
    hit = lambda d: F.col("hit_by_delta")[F.lit(d)].alias(f"hit_{d}")
    return _evaluated(spark, sf_dir).select("query_id", "best_abs_error", "top_candidate_sample_id", *map(hit, DELTAS))


def eval_summary(spark, sf_dir):
    return evaluation.summarize(_evaluated(spark, sf_dir), DELTAS)


def upsert_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return numbering.upsert(
        numbering.last_wins(events.where("event_id % 2 = 0"), "user_id", "event_id"),
        numbering.last_wins(events.where("event_id % 2 = 1"), "user_id", "event_id"),
        "user_id",
    )


def prefix_limit(spark, sf_dir):
    rows = numbering.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return numbering.prefix(rows, 50)


def batch_assign(spark, sf_dir):
    rows = numbering.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source"), F.col("doc_id"))
    return numbering.batched(rows, 64)


def attribute_filter(spark, sf_dir):
    return segments.record_segments(records(spark, sf_dir)).where("video_id = 'src3' and split_name = 'test'").select("segment_id", "sample_index")


def attribute_sort(spark, sf_dir):
    rows = segments.record_segments(records(spark, sf_dir)).where("timestamp_center is not null")
    return rows.orderBy(F.col("timestamp_center").desc(), "sample_index").limit(20).select("segment_id", "timestamp_center")


def windowed_counts(spark, sf_dir):
    """The aggregate of the streaming form, on a table."""
    rows = table(spark, sf_dir, "events")
    start = F.window(F.col("ts").cast("timestamp"), "1 day").start
    counted = rows.groupBy(start.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.date_format("w", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _write_records(spark, sf_dir) -> str:
    """Records of all documents as JSON lines, in the order of their ids."""
    path = scratch_path(spark, "records")
    files.write_lines(records(spark, sf_dir).withColumn("at", F.col("sample_index")), path, "at")
    return path


def records_limit(spark, sf_dir):
    """The first records of a file."""
    return jsonl.read_records(spark, _write_records(spark, sf_dir), 37).select("sample_index", "sample_id", F.md5("transcript_text").alias("text_md5"), "has_timestamp")


def record_segment_scan(spark, sf_dir):
    """Segments of all records of a file, in its order."""
    made = lines.in_order(jsonl.read_record_segments(spark, _write_records(spark, sf_dir)))
    return made.select("ordinal", "segment_id", "start_time", "end_time", F.md5("normalized_text").alias("text_md5"))


def _spaced_lines(spark, sf_dir) -> tuple[str, DataFrame]:
    """A path for documents as JSON lines with a blank line after each, and these lines."""
    docs = table(spark, sf_dir, "documents")
    return scratch_path(spark, "spaced"), docs.select(F.col("doc_id").alias("at"), F.concat(F.to_json(F.struct("doc_id", "text")), F.lit("\n")).alias("line"))


def line_numbers(spark, sf_dir):
    """The numbers of lines through all files, blank ones counted."""
    path, rows = _spaced_lines(spark, sf_dir)
    files.write_lines(rows, path, "at", F.col("line"))
    made = lines.with_line_numbers(jsonl.read_json_lines(spark, path), path, through_files=True)
    return made.select(F.try_variant_get("v", "$.doc_id", "long").alias("doc_id"), "line_number")


def bad_line_number(spark, sf_dir):
    """The line that an error names: one of no object after all documents, blank lines counted; the lines of earlier files come on top."""
    path, good = _spaced_lines(spark, sf_dir)
    last = good.agg((F.max("at") + 1).alias("at")).withColumn("line", F.lit("[1]"))
    files.write_lines(good.unionByName(last), path, "at", F.col("line"))
    try:
        jsonl.read_json_lines(spark, path)
    except ValueError as wrong:
        file, number = re.match(r"(.*), line (\d+): ", str(wrong)).groups()
        earlier = lines.count_lines(spark, path).where(F.col("file") < file).agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n"))
        return earlier.select((F.col("n") + int(number)).alias("line"))
    return spark.createDataFrame([], "line long")


_KINDS = (
    ('true', "True", "true"), ('false', "False", "[]"), ('1e5', "100000.0", "[0]"), ('-0.00001', "-1e-05", "{}"), ('2.50', "2.5", '{"a": 0}'), ('12345678901234567', "12345678901234567", '""'),
    ('1.25e17', "1.25e+17", '"no"'), ('null', "", "0"), ('" a "', " a ", "0.5"), ('0.1', "0.1", "null"), ('9007199254740993', "9007199254740993", "-0.0"),
)
_TRUE = {"true", "[0]", '{"a": 0}', '"no"', "0.5"}


def record_kinds(spark, sf_dir):
    """Records of all documents whose values are of every JSON kind: what they are as texts, as truth values and as numbers."""
    pick = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in _KINDS)), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".75"))).otherwise("true")
    text = F.concat(
        F.lit('{"sample_id": '), F.col("doc_id").cast("string"), F.lit(', "question": '), pick(0), F.lit(', "has_timestamp": '), pick(2), F.lit(', "sample_index": '), number,
        F.lit(', "raw_keys": "ab", "transcript_text": '), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("}"),
    )
    path = scratch_path(spark, "kinds")
    files.write_lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("line")), path, "doc_id", F.col("line"))
    made = jsonl.read_records(spark, path)
    return made.select("sample_id", "question", "has_timestamp", "sample_index", F.md5("transcript_text").alias("text_md5"), F.array_join("raw_keys", ",").alias("raw_keys"))


def _project(spark, sf_dir) -> str:
    """A project folder with windows as segments, which have keys of their own, and frames, some known by their path only."""
    root = scratch_path(spark, "projects")
    rows = windows(spark, sf_dir).select(
        "ordinal", F.concat(F.lit("seg_"), F.col("ordinal").cast("string")).alias("segment_id"), F.col("start_time").cast("string").alias("start_time"), "end_time",
        F.struct(F.col("ordinal").alias("id")).alias("own"), F.concat(F.lit("event "), F.col("ordinal").cast("string")).alias("transcript_text"),
    )
    files.write_lines(rows, f"{root}/p/segments/lecture_segments.jsonl", "ordinal")
    named = F.when(F.col("ordinal") % 2 == 0, F.col("frame_id"))
    grid = frames(spark, sf_dir).select("ordinal", named.alias("frame_id"), F.concat(F.lit("/f/"), F.col("frame_id"), F.lit(".jpg")).alias("frame_path"), "timestamp")
    files.write_lines(grid, f"{root}/p/manifests/frames_manifest.jsonl", "ordinal")
    Folder(spark, f"{root}/p/manifests").write_text("project_manifest.json", files.json_text({"project_id": "p", "counts": {"frames": 7}, "artifacts": 3}))
    return root


def align_workflow(spark, sf_dir):
    """Segments and frames of a project's files aligned into a file, which is read back."""
    root = _project(spark, sf_dir)
    workflows.align_frames(spark, "p", root, 2.0, compression="gzip")
    v = F.col("v")
    rows = jsonl.read_json_lines(spark, f"{root}/p/segments/lecture_segments_aligned.jsonl", check=False)
    refs = F.try_variant_get(v, "$.frame_refs", "array<string>")
    return rows.select(
        F.try_variant_get(v, "$.segment_id", "string").alias("segment_id"), F.try_variant_get(v, "$.own.id", "long").alias("own_id"),
        F.size(refs).cast("long").alias("n_refs"), F.array_join(refs, ",").alias("refs"),
    )


def align_manifest(spark, sf_dir):
    """What the manifest says once a project was aligned."""
    root = _project(spark, sf_dir)
    workflows.align_frames(spark, "p", root, 2.0)
    text = spark.read.text(f"{root}/p/manifests/project_manifest.json", wholetext=True).select(F.parse_json("value").alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    return text.select(
        at("$.project_id", "string").alias("project_id"), at("$.counts.frames", "long").alias("frames"), at("$.counts.lecture_segments_aligned", "long").alias("aligned"),
        at("$.alignment.segments_with_frames", "long").alias("with_frames"), at("$.alignment.frame_refs_total", "long").alias("refs"),
        F.regexp_extract(at("$.artifacts.lecture_segments_aligned", "string"), "[^/]+$", 0).alias("file"),
    )


def index_project_workflow(spark, sf_dir):
    """A project's segments in a stored index, loaded twice, the second time anew."""
    root = _project(spark, sf_dir)
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    for again in (False, True):
        done = workflows.index_project(store, "a/b", f"{root}/p", 64, again)
    own = F.try_variant_get("own", "$.id", "long").alias("own_id")
    rows = store.documents("a/b").select("segment_id", "start_time", "transcript_text", own)
    return rows.withColumn("batches", F.lit(done["indexed_batches"]).cast("long"))


def index_records_workflow(spark, sf_dir):
    """Records of a file in a stored index, in batches of one."""
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    done = workflows.index_records(store, _write_records(spark, sf_dir), "i", "demo", None, 0)
    return store.documents("i").select("segment_id", "project_id", "sample_index", F.lit(done["indexed_documents"]).cast("long").alias("documents"))


def index_recreated(spark, sf_dir):
    """An index that is deleted and made again holds what came after, the last of a key within a batch too."""
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), "doc_id")
    store.create_index("i", "id")
    store.add_documents("i", docs.where("doc_id % 2 = 0"))
    store.delete_index("i")
    store.create_index("i", "id")
    store.add_documents("i", docs.orderBy("doc_id"))
    return store.documents("i")


def store_search(spark, sf_dir):
    """A stored index asked with a filter and an order."""
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    store.create_index("i")
    store.update_settings("i", {"searchableAttributes": ["transcript_text"], "filterableAttributes": ["video_id"], "sortableAttributes": ["timestamp_center"]})
    store.add_documents("i", segments.record_segments(records(spark, sf_dir)))
    found = store.search("i", questions(spark, sf_dir), 5, {"video_id": ["src1", "src3"]}, ["timestamp_center:desc"])
    return found.select("query_id", "rank", "segment_id", "timestamp_center")


def eval_workflow(spark, sf_dir):
    """Records of a file evaluated against an index of all documents, as the written rows say."""
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    store.create_index("i")
    store.update_settings("i", {"searchableAttributes": ["transcript_text"]})
    store.add_documents("i", segments.record_segments(records(spark, sf_dir)))
    asked = questions(spark, sf_dir).select(F.col("query_id").alias("at"), F.col("query_id").cast("string").alias("sample_id"), F.col("query").alias("question"), "timestamp_points")
    path, out = scratch_path(spark, "asked"), scratch_path(spark, "evaluated")
    files.write_lines(asked, path, "at")
    workflows.evaluate_records(store, path, "i", 5, None, DELTAS, out)
    at = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return jsonl.read_json_lines(spark, out).select(
        at("sample_id", "long").alias("query_id"), at("best_abs_error", "double").alias("best_abs_error"),
        *(at(f"hit_by_delta.{d}", "boolean").alias(f"hit_{d}") for d in DELTAS), at("topk_candidates[0].sample_id", "string").alias("top_candidate_sample_id"),
    )


def eval_workflow_summary(spark, sf_dir):
    """The printed summary of the first questions of a file."""
    store = IndexStore(ship(spark), scratch_path(spark, "index"))
    store.create_index("i")
    store.update_settings("i", {"searchableAttributes": ["transcript_text"]})
    store.add_documents("i", segments.record_segments(records(spark, sf_dir)))
    asked = questions(spark, sf_dir).select(F.col("query_id").alias("at"), F.col("query").alias("question"), "timestamp_points")
    path = scratch_path(spark, "asked")
    files.write_lines(asked, path, "at")
    summary = workflows.evaluate_records(store, path, "i", 5, 20, DELTAS)
    return spark.createDataFrame([summary], "count long, mean_abs_error double, hit_at_60s double, hit_at_300s double, hit_at_900s double")


def _tools(command):
    """Stands in for the video tools: a probe, and a file for each of three frames."""
    if command[0] == "ffprobe":
        return '{"streams": [{"width": "640", "height": 480, "r_frame_rate": "30/1"}], "format": {"duration": "3.5"}}'
    if command[-1].endswith(".jpg"):
        for i in (1, 2, 3):
            Path(command[-1].replace("%06d", f"{i:06d}")).touch()
    return ""


def _local_folder(spark, name: str) -> Path:
    """A shared folder as a local path: the tools of one video work on local files."""
    path = Path(re.sub("^file:/+", "/", scratch_path(spark, name)))
    path.mkdir(parents=True)
    return path


def ingest_workflow(spark, sf_dir):
    """A video whose subtitles are the benchmark's texts, ingested with stand-ins for the video tools: its segments' file."""
    folder = _local_folder(spark, "ingest")
    (folder / "my talk.mp4").touch()
    cue = F.concat(
        F.lit("1\n"), F.format_string("%02d:%02d:%02d,500", F.col("item_id") % 24, F.col("item_id") % 60, F.col("item_id") * 7 % 60), F.lit(" --> "),
        F.format_string("%02d:%02d:%02d.000", F.col("item_id") % 24, F.col("item_id") % 60, F.col("item_id") * 7 % 60 + 1), F.lit("\n"), S.collapse_space(F.col("text")), F.lit("\n"),
    )
    files.write_lines(table(spark, sf_dir, "benchmark").select("item_id", cue.alias("line")), f"file://{folder}/my talk.srt", "item_id", F.col("line"), one_file=True)
    config = workflows.IngestConfig(video_path=folder / "my talk.mp4", project_id="p", video_id="my_talk", output_root=folder / "projects")
    made = workflows.ingest_video(spark, config, _tools)
    rows = jsonl.read_json_lines(spark, f"file://{made['artifacts']['lecture_segments']}")
    at = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return rows.select(
        at("sample_index", "long").alias("seq_no"), at("segment_id", "string").alias("segment_id"), at("start_time", "double").alias("start_time"),
        at("end_time", "double").alias("end_time"), F.md5(at("transcript_text", "string")).alias("text_md5"),
        F.lit(made["counts"]["lecture_segments"]).cast("long").alias("counted"), F.lit(made["transcript_source"]).alias("transcript_source"),
    )


def frame_grids(spark, sf_dir):
    """A grid of frames for each conversation as if it were a video, at its own rate, with as many frames as its texts have words."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    videos = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video")).agg(F.sum(words).alias("frames"))
    videos = videos.withColumn("fps", F.element_at(F.array(F.lit(29.97), F.lit(80.0), F.lit(400.0), F.lit(0.0)), (F.col("video") % 4 + 1).cast("int")))
    grids = media.frame_grids(videos, F.concat(F.lit("v"), F.col("video").cast("string")))
    return grids.select(F.col("video").alias("conv_id"), "frame_id", "frame_path", "timestamp")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mention_candidates, slugify, excerpt, text_functions, number_functions, transcript_source, record_coerce, record_segments,
        jsonl_scan, records_by_id, index_documents, eval_rows, time_and_delta_functions, variant_numbers,
        srt_roundtrip, srt_large_files, cue_segments, stt_normalize, frame_grid, frame_grid_rates, rounding, segment_window, interval_align, align_summary,
        search_topk, search_candidates, abs_errors, eval_per_query, eval_summary, upsert_last_wins, prefix_limit, batch_assign,
        attribute_filter, attribute_sort, windowed_counts, records_limit, record_segment_scan, line_numbers, bad_line_number, record_kinds, align_workflow, align_manifest,
        index_project_workflow, index_records_workflow, index_recreated, store_search, eval_workflow, eval_workflow_summary, ingest_workflow, frame_grids,
    )
}

_HINTS = ", ".join(f"'{h}'" for h in S.DEICTIC_HINTS)


def _sql_points(key: str) -> str:
    return f"CASE WHEN {key} % 5 = 0 THEN []::DOUBLE[] ELSE [({key} * 37 % 3600)::DOUBLE, ({key} * 53 % 3600)::DOUBLE] END"


def _sql_slug(text: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({text}, '[^A-Za-z0-9_.:-]+', '_', 'g'), '_'), ''), 'empty')"


def _sql_mentions(text: str) -> str:
    return f"array_to_string(list_filter([{_HINTS}], lambda h: contains(lower({text}), h)), '|')"


_CENTER = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ((doc_id * 37 % 3600)::DOUBLE + (doc_id * 53 % 3600)::DOUBLE) / 2 END"
_STEM = r"regexp_replace(list_last(string_split(regexp_replace({0}, '/+$', ''), '/')), '^(.+)\.[^.]+$', '\1')"
_SPACED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SEGMENT_ID = "'seg_' || " + _sql_slug("source || '/' || doc_id")
_WINDOWS = """
    wins AS (
        SELECT event_id AS ordinal, epoch_us(ts) / 1000000.0::DOUBLE - (event_id % 7 * 30)::DOUBLE AS start_time,
               epoch_us(ts) / 1000000.0::DOUBLE + (event_id % 7 * 30)::DOUBLE AS end_time
        FROM events WHERE event_type = 'purchase'),
    pts AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS at FROM events WHERE event_type = 'click')"""
_ALIGNED = f"""{_WINDOWS},
    met AS (
        SELECT w.ordinal, p.event_id FROM wins w LEFT JOIN pts p ON p.at BETWEEN w.start_time - 2 AND w.end_time + 2)"""
_REFS = f"""
    WITH {_ALIGNED}
    SELECT ordinal, count(event_id) AS n_refs, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id), '') AS refs
    FROM met GROUP BY ordinal"""
_HITS = r"""
    docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
    sizes AS (SELECT doc_id, len(words)::DOUBLE AS size FROM docs),
    stats AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
    tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (
        SELECT DISTINCT query_id, term FROM (
            SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)),
    scored AS (
        SELECT query_id, doc_id,
               sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
        FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), stats GROUP BY ALL),
    hits AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
        WHERE rank <= 5)"""
_ERRORS = f"""{_HITS},
    gold AS (SELECT item_id AS query_id, unnest({_sql_points("item_id")}) AS point FROM benchmark),
    errors AS (
        SELECT query_id, rank, point, abs(center - point) AS error
        FROM gold JOIN (SELECT query_id, rank, {_CENTER} AS center FROM hits) USING (query_id) WHERE center IS NOT NULL)"""
_BEST = f"""{_ERRORS},
    best AS (SELECT item_id AS query_id, (SELECT min(error) FROM errors e WHERE e.query_id = item_id) AS best_abs_error FROM benchmark)"""

SQL: dict[str, str] = {
    "mention_candidates": f"SELECT doc_id, {_sql_mentions('text')} AS mentions FROM documents",
    "slugify": f"SELECT doc_id, md5({_sql_slug('text')}) AS slug_md5, length({_sql_slug('text')}) AS slug_chars FROM documents",
    "excerpt": "SELECT doc_id, CASE WHEN length(text) > 360 THEN substr(text, 1, 360) || '...' ELSE text END AS excerpt FROM documents",
    "text_functions": f"""
        SELECT page_id, {_SPACED.format("html")} AS collapsed, {_STEM.format("url")} AS stem, {_sql_slug(_STEM.format("url"))} AS video_id
        FROM pages""",
    "number_functions": """
        SELECT l_linenumber, count(*) FILTER (l_linenumber % 3 <> 1) AS doubles,
               sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 2 THEN l_linenumber::DOUBLE END) AS total,
               count(*) FILTER (l_linenumber % 3 = 2) AS longs
        FROM lineitem GROUP BY l_linenumber""",
    "transcript_source": """
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'srt' ELSE 'stt' END
               WHEN 1 THEN 'none' WHEN 2 THEN 'srt' ELSE 'stt' END AS transcript_source
        FROM documents""",
    "record_coerce": """
        SELECT doc_id AS sample_index, source || '/' || doc_id AS sample_id, source AS video_name, md5(text) AS question_md5, md5(text) AS transcript_md5,
               '' AS answer, (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END)::BIGINT AS n_points, doc_id % 5 <> 0 AS has_timestamp,
               CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS qid
        FROM documents""",
    "jsonl_scan": """
        SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS lang, doc_id % 3 <> 0 AS is_null
        FROM documents""",
    "records_by_id": "SELECT source || '/' || lang AS sample_id, max(doc_id) AS doc_id FROM documents GROUP BY 1",
    "index_documents": f"""
        SELECT {_SEGMENT_ID} AS segment_id, doc_id AS sample_index, CASE WHEN doc_id % 3 <> 0 THEN 'second' ELSE source END AS video_name
        FROM documents""",
    "eval_rows": f"""
        WITH {_HITS},
        lists AS (
            SELECT query_id, count(*) AS n, string_agg(rank || ':' || source || '/' || doc_id, ',' ORDER BY rank) AS candidates
            FROM hits JOIN documents USING (doc_id) GROUP BY query_id)
        SELECT item_id AS query_id, (CASE WHEN item_id % 5 = 0 THEN 0 ELSE 2 END)::BIGINT AS n_points, coalesce(n, 0) AS n_candidates,
               coalesce(candidates, '') AS candidates
        FROM benchmark LEFT JOIN lists ON query_id = item_id""",
    "time_and_delta_functions": """
        SELECT doc_id, (doc_id % 24 * 3600 + doc_id % 60 * 60 + doc_id * 7 % 60)::DOUBLE + (doc_id * 13 % 1000)::DOUBLE / 1000 AS seconds,
               doc_id || '|' || (doc_id + 1) AS deltas
        FROM documents""",
    "variant_numbers": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN event_id + 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS as_double,
               CASE event_id % 4 WHEN 0 THEN event_id WHEN 2 THEN 1 END AS as_long
        FROM events""",
    "record_segments": f"""
        SELECT {_SEGMENT_ID} AS segment_id, doc_id AS sample_index, source AS video_id,
               CASE WHEN doc_id % 5 <> 0 THEN greatest(0.0::DOUBLE, {_CENTER} - 90) END AS start_time, {_CENTER} + 90 AS end_time,
               {_CENTER} AS timestamp_center, {_sql_mentions("text || ' ' || text")} AS mentions, 'eduvidqa' AS source
        FROM documents""",
    "srt_roundtrip": f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq_no, (turn * 10)::DOUBLE AS start_time,
               (turn * 10 + 8)::DOUBLE AS end_time, {_SPACED.format("text")} AS text
        FROM conversations""",
    "srt_large_files": f"""
        SELECT row_number() OVER (ORDER BY doc_id) AS seq_no, (doc_id % 24 * 3600 + doc_id % 60 * 60 + doc_id * 7 % 60)::DOUBLE + (doc_id % 1000)::DOUBLE / 1000 AS start_time,
               (doc_id % 24 * 3600 + doc_id % 60 * 60 + (doc_id * 7 + 1) % 60)::DOUBLE + (doc_id % 1000)::DOUBLE / 1000 AS end_time, md5({_SPACED.format("text")}) AS text_md5
        FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND {_SPACED.format("text")} <> ''""",
    "cue_segments": f"""
        SELECT 'seg_conv_' || conv_id || '_' || printf('%06d', turn + 1) AS segment_id, turn + 1 AS sample_index,
               (turn * 10)::DOUBLE AS start_time, (turn * 10 + 8)::DOUBLE AS end_time, (turn * 10 + 4)::DOUBLE AS timestamp_center,
               lower({_SPACED.format("text")}) AS normalized_text, 'ingest' AS split_name
        FROM conversations""",
    "stt_normalize": f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq_no, (turn * 10)::DOUBLE AS start_time,
               (turn * 10 + CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END)::DOUBLE AS end_time, {_SPACED.format("text")} AS text
        FROM conversations WHERE turn % 4 <> 3""",
    "frame_grid": """
        SELECT printf('frame_%06d', i) AS frame_id, printf('frames/frame_%06d.jpg', i) AS frame_path,
               round((i - 1)::DOUBLE / 29.97::DOUBLE, 3) AS timestamp
        FROM range(1, (SELECT count(*) FROM benchmark) + 1) t(i)""",
    "segment_window": f"""
        WITH {_WINDOWS},
        ends AS (
            SELECT ordinal, CASE WHEN ordinal % 4 <> 1 THEN start_time END AS a,
                   CASE WHEN ordinal % 4 <> 2 THEN CASE WHEN ordinal % 8 = 0 THEN start_time - 5 ELSE end_time END END AS b
            FROM wins)
        SELECT ordinal, least(coalesce(a, b), coalesce(b, a)) - 0.5 AS lo, greatest(coalesce(a, b), coalesce(b, a)) + 0.5 AS hi
        FROM ends""",
    "interval_align": _REFS,
    "align_summary": f"""
        WITH {_ALIGNED},
        each AS (SELECT ordinal, count(event_id) AS n FROM met GROUP BY ordinal)
        SELECT 2.0::DOUBLE AS margin_seconds, count(*) AS segments_total, count(*) FILTER (n > 0) AS segments_with_frames,
               count(*) FILTER (n = 0) AS segments_without_frames, sum(n)::BIGINT AS frame_refs_total,
               (SELECT count(DISTINCT event_id) FROM met) AS unique_frames_referenced
        FROM each""",
    "search_topk": f"WITH {_HITS} SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM hits",
    "search_candidates": f"""
        WITH {_HITS}
        SELECT query_id, rank::INTEGER AS rank, {_SEGMENT_ID} AS segment_id, source AS video_id, {_CENTER} AS timestamp_center,
               md5(CASE WHEN length(text) > 360 THEN substr(text, 1, 360) || '...' ELSE text END) AS excerpt_md5
        FROM hits JOIN documents USING (doc_id)""",
    "abs_errors": f"WITH {_ERRORS} SELECT query_id, rank::INTEGER AS rank, point, error FROM errors",
    "eval_per_query": f"""
        WITH {_BEST}
        SELECT b.query_id, best_abs_error, d.source || '/' || d.doc_id AS top_candidate_sample_id,
               coalesce(best_abs_error <= 60, false) AS hit_60, coalesce(best_abs_error <= 300, false) AS hit_300,
               coalesce(best_abs_error <= 900, false) AS hit_900
        FROM best b LEFT JOIN hits h ON h.query_id = b.query_id AND h.rank = 1 LEFT JOIN documents d ON d.doc_id = h.doc_id""",
    "eval_summary": f"""
        WITH {_BEST}
        SELECT count(*) AS count, printf('%.4f', avg(best_abs_error))::DOUBLE AS mean_abs_error,
               printf('%.4f', (count(*) FILTER (best_abs_error <= 60))::DOUBLE / count(*))::DOUBLE AS hit_at_60s,
               printf('%.4f', (count(*) FILTER (best_abs_error <= 300))::DOUBLE / count(*))::DOUBLE AS hit_at_300s,
               printf('%.4f', (count(*) FILTER (best_abs_error <= 900))::DOUBLE / count(*))::DOUBLE AS hit_at_900s
        FROM best""",
    "upsert_last_wins": """
        SELECT user_id, event_id, event_type FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS n FROM events)
        WHERE n = 1""",
    "prefix_limit": """
        SELECT * FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) WHERE ordinal < 50""",
    "batch_assign": """
        SELECT *, ordinal // 64 AS batch FROM (
            SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents)""",
    "attribute_filter": f"SELECT {_SEGMENT_ID} AS segment_id, doc_id AS sample_index FROM documents WHERE source = 'src3'",
    "attribute_sort": f"""
        SELECT {_SEGMENT_ID} AS segment_id, {_CENTER} AS timestamp_center FROM documents
        WHERE doc_id % 5 <> 0 ORDER BY timestamp_center DESC, doc_id LIMIT 20""",
    "windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "frame_grid_rates": """
        SELECT fps, printf('frame_%06d', i) AS frame_id, printf('%.3f', (i - 1)::DOUBLE / fps)::DOUBLE AS timestamp
        FROM range(1, (SELECT count(*) FROM documents) + 1) t(i), (VALUES (29.97::DOUBLE), (80.0::DOUBLE), (400.0::DOUBLE)) r(fps)""",
    "rounding": """
        SELECT doc_id, printf('%.4f', doc_id::DOUBLE / 80)::DOUBLE AS r0, printf('%.4f', doc_id::DOUBLE / 400)::DOUBLE AS r1,
               printf('%.4f', doc_id::DOUBLE / 20000)::DOUBLE AS r2, printf('%.4f', -doc_id::DOUBLE / 7)::DOUBLE AS r3,
               printf('%.4f', doc_id::DOUBLE * 0.00005::DOUBLE)::DOUBLE AS r4
        FROM documents""",
    "records_limit": """
        SELECT doc_id AS sample_index, source || '/' || doc_id AS sample_id, md5(text) AS text_md5, doc_id % 5 <> 0 AS has_timestamp
        FROM documents ORDER BY doc_id LIMIT 37""",
    "record_segment_scan": f"""
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, {_SEGMENT_ID} AS segment_id,
               CASE WHEN doc_id % 5 <> 0 THEN greatest(0.0::DOUBLE, {_CENTER} - 90) END AS start_time, {_CENTER} + 90 AS end_time, md5(lower(text)) AS text_md5
        FROM documents""",
    "line_numbers": "SELECT doc_id, 2 * row_number() OVER (ORDER BY doc_id) - 1 AS line_number FROM documents",
    "record_kinds": f"""
        SELECT doc_id::VARCHAR AS sample_id, [{", ".join("'" + k[1] + "'" for k in _KINDS)}][doc_id % {len(_KINDS)} + 1] AS question,
               [{", ".join(str(k[2] in _TRUE).lower() for k in _KINDS)}][doc_id % {len(_KINDS)} + 1] AS has_timestamp,
               CASE WHEN doc_id % 3 = 2 THEN 1 ELSE doc_id END AS sample_index, md5(text) AS text_md5, 'a,b' AS raw_keys
        FROM documents""",
    "bad_line_number": "SELECT 2 * count(*) + 1 AS line FROM documents",
    "align_workflow": f"""
        WITH {_ALIGNED}
        SELECT 'seg_' || ordinal AS segment_id, ordinal AS own_id, count(event_id) AS n_refs,
               coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id), '') AS refs
        FROM met GROUP BY ordinal""",
    "align_manifest": f"""
        WITH {_ALIGNED},
        each AS (SELECT ordinal, count(event_id) AS n FROM met GROUP BY ordinal)
        SELECT 'p' AS project_id, 7::BIGINT AS frames, count(*) AS aligned, count(*) FILTER (n > 0) AS with_frames, sum(n)::BIGINT AS refs,
               'lecture_segments_aligned.jsonl' AS file
        FROM each""",
    "index_project_workflow": f"""
        WITH {_WINDOWS}
        SELECT 'seg_' || ordinal AS segment_id, start_time, 'event ' || ordinal AS transcript_text, ordinal AS own_id,
               ((SELECT count(*) FROM wins) + 63) // 64 AS batches
        FROM wins""",
    "index_records_workflow": f"""
        SELECT {_SEGMENT_ID} AS segment_id, 'demo' AS project_id, doc_id AS sample_index, (SELECT count(*) FROM documents) AS documents
        FROM documents""",
    "index_recreated": "SELECT source AS id, max(doc_id) AS doc_id FROM documents GROUP BY source",
    "store_search": f"""
        WITH {_HITS},
        ranked AS (
            SELECT query_id, d.doc_id, d.source,
                   row_number() OVER (PARTITION BY query_id ORDER BY {_CENTER.replace("doc_id", "d.doc_id")} DESC NULLS LAST, round(score, 9) DESC, {_SEGMENT_ID.replace("doc_id", "d.doc_id")}) AS place
            FROM scored JOIN documents d USING (doc_id) WHERE d.source IN ('src1', 'src3'))
        SELECT query_id, place::INTEGER AS rank, {_SEGMENT_ID} AS segment_id, {_CENTER} AS timestamp_center FROM ranked WHERE place <= 5""",
    "ingest_workflow": f"""
        SELECT row_number() OVER (ORDER BY item_id) AS seq_no, 'seg_my_talk_' || printf('%06d', row_number() OVER (ORDER BY item_id)) AS segment_id,
               (item_id % 24 * 3600 + item_id % 60 * 60 + item_id * 7 % 60)::DOUBLE + 0.5 AS start_time,
               (item_id % 24 * 3600 + item_id % 60 * 60 + item_id * 7 % 60 + 1)::DOUBLE AS end_time, md5({_SPACED.format("text")}) AS text_md5,
               count(*) OVER () AS counted, 'srt' AS transcript_source
        FROM benchmark""",
    "frame_grids": r"""
        WITH videos AS (
            SELECT conv_id, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS frames,
                   [29.97::DOUBLE, 80.0::DOUBLE, 400.0::DOUBLE, NULL][conv_id % 4 + 1] AS fps
            FROM conversations GROUP BY conv_id)
        SELECT conv_id, printf('frame_%06d', i) AS frame_id, printf('v%d/frame_%06d.jpg', conv_id, i) AS frame_path,
               printf('%.3f', (i - 1)::DOUBLE / fps)::DOUBLE AS timestamp
        FROM (SELECT conv_id, fps, unnest(range(1, frames + 1)) AS i FROM videos)""",
}
_TOP_BY_SEGMENT = SQL["eval_per_query"].replace("round(score, 9) DESC, doc_id)", f"round(score, 9) DESC, (SELECT {_SEGMENT_ID} FROM documents s WHERE s.doc_id = scored.doc_id))")
SQL["eval_workflow"] = _TOP_BY_SEGMENT
SQL["eval_workflow_summary"] = (
    SQL["eval_summary"].replace("round(score, 9) DESC, doc_id)", f"round(score, 9) DESC, (SELECT {_SEGMENT_ID} FROM documents s WHERE s.doc_id = scored.doc_id))")
    + " WHERE query_id IN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 20)"
)
