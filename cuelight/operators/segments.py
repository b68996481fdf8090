"""Lecture segments from question records and from timed cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import scalars as S
from cuelight.schemas import SEGMENT

# Names that segments carry.
RECORD_PROJECT = RECORD_SOURCE = "eduvidqa"
LOCAL_DATASET, LOCAL_SUBSET, LOCAL_SPLIT = "local_video", "pilot", "ingest"


def _segment(df: DataFrame, carried: list[str], **columns: Column) -> DataFrame:
    typed = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SEGMENT.fields]
    return df.select(*carried, *typed)


def _empty_list() -> Column:
    return F.array().cast("array<string>")


def record_segments(
    records: DataFrame, project_id: str = RECORD_PROJECT, context_seconds: float = 90.0, carried: list[str] | None = None
) -> DataFrame:
    """A segment for each record: centred on the mean of its time points, ``context_seconds`` to either side.

    The start is never before 0. Without points there are no times. ``carried`` columns are kept in front.
    """
    center = S.mean(F.col("timestamp_points"))
    said = F.concat(F.col("question"), F.lit(" "), F.col("transcript_text"))
    return _segment(
        records,
        carried or [],
        segment_id=F.concat(F.lit("seg_"), S.slugify(F.col("sample_id"))),
        project_id=F.lit(project_id),
        **{c: F.col(c) for c in ("dataset_name", "subset_name", "split_name", "sample_id", "sample_index", "video_name")},
        video_id=F.col("video_name"),
        start_time=F.when(center.isNotNull(), F.greatest(F.lit(0.0), center - context_seconds)),
        end_time=center + context_seconds,
        timestamp_center=center,
        timestamp_points=F.col("timestamp_points"),
        transcript_text=F.col("transcript_text"),
        normalized_text=F.lower("transcript_text"),
        frame_refs=_empty_list(),
        mention_candidates=S.mention_candidates(said),
        source=F.lit(RECORD_SOURCE),
    )


def cue_segments(
    cues: DataFrame, project_id: str, video_id: str | Column, source: str = "srt", carried: list[str] | None = None
) -> DataFrame:
    """A segment for each cue (seq_no, start_time, end_time, text) of a video."""
    video = video_id if isinstance(video_id, Column) else F.lit(video_id)
    name = F.concat(F.lit("seg_"), S.slugify(video), F.lit("_"), F.format_string("%06d", F.col("seq_no")))
    center = (F.col("start_time") + F.col("end_time")) / 2
    return _segment(
        cues,
        carried or [],
        segment_id=name,
        project_id=F.lit(project_id),
        dataset_name=F.lit(LOCAL_DATASET),
        subset_name=F.lit(LOCAL_SUBSET),
        split_name=F.lit(LOCAL_SPLIT),
        sample_id=name,
        sample_index=F.col("seq_no"),
        video_id=video,
        video_name=video,
        start_time=F.col("start_time"),
        end_time=F.col("end_time"),
        timestamp_center=center,
        timestamp_points=F.array(center),
        transcript_text=F.col("text"),
        normalized_text=F.lower("text"),
        frame_refs=_empty_list(),
        mention_candidates=S.mention_candidates(F.col("text")),
        source=F.lit(source),
    )
