"""How near in time the candidates of a question come to its gold points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions import scalars as S


def absolute_errors(questions: DataFrame, candidates: DataFrame, same_video: bool = False) -> DataFrame:
    """(query_id, rank, point, error) for each gold point and candidate of a question.

    questions: query_id, timestamp_points. Whether a candidate is of the same video does not matter, unless
    ``same_video`` asks for it (questions then need video_name): an addition to the measure.
    """
    gold = questions.select("query_id", *(["video_name"] if same_video else []), F.explode("timestamp_points").alias("point"))
    met = gold.join(candidates.where("timestamp_center is not null"), "query_id")
    if same_video:
        met = met.where("video_name = video_id")
    return met.select("query_id", "rank", "point", F.abs(F.col("timestamp_center") - F.col("point")).alias("error"))


def evaluate(questions: DataFrame, candidates: DataFrame, deltas: Sequence[int] = (5, 10, 15), same_video: bool = False) -> DataFrame:
    """Every question with best_abs_error (null without a pair), hit_by_delta and top_candidate_sample_id."""
    best = absolute_errors(questions, candidates, same_video).groupBy("query_id").agg(F.min("error").alias("best_abs_error"))
    top = candidates.groupBy("query_id").agg(F.min_by("sample_id", "rank").alias("top_candidate_sample_id"))
    deltas = list(dict.fromkeys(deltas))
    hits = F.map_from_arrays(
        F.array(*map(F.lit, deltas)), F.array(*(F.coalesce(F.col("best_abs_error") <= d, F.lit(False)) for d in deltas))
    )
    return questions.join(best, "query_id", "left").join(top, "query_id", "left").withColumn("hit_by_delta", hits)


def with_candidates(evaluated: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``topk_candidates``, an array of candidates in the order of their ranks."""
    own = [c for c in candidates.columns if c != "query_id"]
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("topk_candidates"))
    return evaluated.join(lists, "query_id", "left").withColumn("topk_candidates", F.coalesce("topk_candidates", F.array()))


def summarize(evaluated: DataFrame, deltas: Sequence[int] = (5, 10, 15)) -> DataFrame:
    """One row: count, mean_abs_error of those with an error, and for each delta the share of all questions that hit."""
    count = F.count("*")
    rates = [
        F.coalesce(S.rounded(F.count_if(F.col("hit_by_delta")[F.lit(d)]) / F.nullif(count, F.lit(0)), 4)).alias(f"hit_at_{d}s")
        for d in dict.fromkeys(deltas)
    ]
    return evaluated.agg(count.alias("count"), S.rounded(F.avg("best_abs_error"), 4).alias("mean_abs_error"), *rates)


def as_summary(row) -> dict:
    """The summary as it is printed: only the count where there are no questions."""
    return {"count": 0} if not row["count"] else row.asDict()
