"""Segments that arrive as a stream, aligned with a table of frames. An addition: the same expressions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.operators import intervals
from cuelight.operators.numbering import numbered
from cuelight.schemas import struct

SEGMENT_LINE = struct(segment_id="string", start_time="double", end_time="double", transcript_text="string")


def read_segments(spark: SparkSession, folder: str, schema: T.StructType = SEGMENT_LINE) -> DataFrame:
    """JSON lines that land in a folder."""
    return spark.readStream.schema(schema).json(folder)


def align_stream(segments: DataFrame, frames: DataFrame, target: str, checkpoint: str, margin: float = 0.0):
    """Starts a query that appends each batch of segments with its frames to a Parquet folder.

    A batch is aligned whole and written once under its number, so a batch that is repeated after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = numbered(batch, *batch.columns)
        aligned = intervals.align(rows, frames, margin).drop("ordinal")
        aligned.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return segments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """events: ts, event_type. Counts by window and type, closed once the watermark has passed."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n")
    )
