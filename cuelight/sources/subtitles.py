"""SubRip files and speech-to-text results as timed cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions import scalars as S
from cuelight.scratch import written
from cuelight.sources.lines import count_lines, read_lines, with_runs

# The form of a timing line, and the characters at which a line ends.
_STAMP = r"[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}"
_TIMING = rf"({_STAMP})\s*-->\s*({_STAMP})"
_GROUP_BITS = 12  # cues of so many blocks are numbered in one task
_LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x85  ]"


def srt_cues(files: DataFrame) -> DataFrame:
    """files: path, value (a whole file). (path, seq_no, start_time, end_time, text) of its cues.

    Blocks are parted by blank lines. The first line with a timing counts, what stands before it is ignored, and the lines
    after it are joined by a space. Blocks without a timing or without a text are skipped and not numbered.
    """
    body = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    blocks = files.select("path", F.posexplode(F.split(S.strip(body), r"\n(?U)\s*\n")).alias("pos", "block"))
    cues = _timed(blocks.select("path", "pos", F.split("block", _LINE_END).alias("lines")))
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    return cues.select("path", number.cast("long").alias("seq_no"), "start_time", "end_time", "text")


def _timed(blocks: DataFrame) -> DataFrame:
    """Blocks (``lines``, other columns kept) that hold a timing and a text after it, with start_time, end_time and text."""
    kept = [c for c in blocks.columns if c != "lines"]
    lines = F.filter(F.transform("lines", S.strip), lambda line: line != "")
    timed = F.transform(F.col("lines"), lambda line: line.rlike(_TIMING))
    cues = (
        blocks.select(*kept, lines.alias("lines"))
        .withColumn("at", F.array_position(timed, True).cast("int"))
        .where((F.col("at") > 0) & (F.size("lines") > F.col("at")))
        .withColumn("timing", F.element_at("lines", F.col("at")))
    )
    return cues.select(
        *kept,
        S.subtitle_seconds(F.regexp_extract("timing", _TIMING, 1)).alias("start_time"),
        S.subtitle_seconds(F.regexp_extract("timing", _TIMING, 2)).alias("end_time"),
        F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " ").alias("text"),
    )


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """The cues of each file at ``path``, as ``srt_cues`` has them. Files are read by ranges of bytes, so one large file is many tasks' work; a block that goes on
    over the end of a range is put together, and cues are numbered by sums of counts of neighbouring blocks."""
    rows = with_runs(read_lines(spark, path), count_lines(spark, path))
    listed = F.sort_array(F.collect_list(F.struct("start", "row", "line")))
    blocks = rows.groupBy(F.col("file").alias("path"), "block").agg(listed.alias("rows"))
    lines = F.flatten(F.transform("rows", lambda r: F.split(r.line.cast("string"), _LINE_END)))
    cues = written(_timed(blocks.select("path", "block", lines.alias("lines"))).withColumn("group", F.shiftright("block", _GROUP_BITS)))
    counts = cues.groupBy("path", "group").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("path", "group", F.coalesce(earlier, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("path", "group").orderBy("block"))
    return cues.withColumn("nth", nth).join(bases, ["path", "group"]).select("path", (F.col("base") + F.col("nth")).alias("seq_no"), "start_time", "end_time", "text")


def stt_segments(results: DataFrame, result: Column, key: str = "path") -> DataFrame:
    """(key, seq_no, start_time, end_time, text) from variants {text?, segments?: [{start?, end?, text?}]}.

    White space is collapsed and blank segments are dropped before numbering. A start that is missing or bad is 0, an end
    the start, and no end is before its start. If no segment is left, the whole text is one from 0 to 0.
    """
    parts = F.coalesce(F.try_variant_get(result, "$.segments", "array<variant>"), F.array().cast("array<variant>"))
    text_of = lambda s: S.collapse_space(F.coalesce(F.try_variant_get(s, "$.text", "string"), F.lit("")))
    time_of = lambda s, k: S.variant_double(F.try_variant_get(s, f"$.{k}", "variant"))
    kept = F.filter(
        F.transform(
            parts,
            lambda s: F.struct(
                F.coalesce(time_of(s, "start"), F.lit(0.0)).alias("start"), time_of(s, "end").alias("end"), text_of(s).alias("text")
            ),
        ),
        lambda s: s.text != "",
    )
    whole = S.collapse_space(F.coalesce(F.try_variant_get(result, "$.text", "string"), F.lit("")))
    spare = F.when(whole != "", F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), whole.alias("text")))).otherwise(
        F.array().cast("array<struct<start:double,end:double,text:string>>")
    )
    every = results.select(F.col(key), kept.alias("kept"), spare.alias("spare"))
    chosen = every.select(key, F.posexplode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("spare"))).alias("pos", "s"))
    start, end = F.col("s.start"), F.coalesce(F.col("s.end"), F.col("s.start"))
    return chosen.select(
        key,
        (F.col("pos") + 1).cast("long").alias("seq_no"),
        start.alias("start_time"),
        F.when(end < start, start).otherwise(end).alias("end_time"),
        F.col("s.text").alias("text"),
    )
