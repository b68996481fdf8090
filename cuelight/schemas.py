"""Schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(**fields: str) -> T.StructType:
    """A schema from names and types; ``[string]`` is an array."""
    made = T.StructType()
    for name, kind in fields.items():
        made.add(name, T.ArrayType(_TYPES[kind[1:-1]]) if kind[0] == "[" else _TYPES[kind])
    return made


RECORD = struct(
    dataset_name="string", subset_name="string", split_name="string", sample_index="long", sample_id="string",
    video_name="string", question="string", answer="string", transcript_text="string", timestamp_points="[double]",
    has_timestamp="boolean", qid="string", raw_keys="[string]",
)

SEGMENT = struct(
    segment_id="string", project_id="string", dataset_name="string", subset_name="string", split_name="string",
    sample_id="string", sample_index="long", video_id="string", video_name="string", start_time="double",
    end_time="double", timestamp_center="double", timestamp_points="[double]", transcript_text="string",
    normalized_text="string", slide_id="string", frame_refs="[string]", mention_candidates="[string]", source="string",
)

CANDIDATE = struct(
    rank="int", segment_id="string", sample_id="string", video_id="string", start_time="double", end_time="double",
    timestamp_center="double", transcript_excerpt="string", score="double",
)

CUE = struct(seq_no="long", start_time="double", end_time="double", text="string")

FRAME = struct(frame_id="string", frame_path="string", timestamp="double")

# How an index treats attributes; searchable ones in order of priority.
INDEX_SETTINGS = {
    "searchableAttributes": ["transcript_text", "normalized_text", "mention_candidates", "video_name"],
    "filterableAttributes": ["project_id", "dataset_name", "subset_name", "split_name", "video_id", "video_name", "source"],
    "sortableAttributes": ["timestamp_center", "sample_index"],
    "displayedAttributes": ["*"],
}
