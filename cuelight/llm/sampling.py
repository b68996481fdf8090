"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.scratch import discard, written


def fold(doc_id: str, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(of))


def graded_sample(labels: DataFrame, grade: str, most_per_grade: int, max_grades: int = 16) -> tuple[DataFrame, dict]:
    """The sample, and how many labelled rows each grade has in all. The sample: (doc_id, grade int) of at most ``most_per_grade`` rows of each grade, in the order of a hash of doc_id.

    Rows with a null id or grade are left out; of rows that repeat an id the highest grade counts.
    A grade's rows are thinned by a threshold on the hash that its count gives, then cut to the bound:
    a grade never gathers in one task. More than ``max_grades`` grades are an error: each has a sample on the driver, and a scale
    of so many is a continuous one.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(grade).cast("int")).alias("grade"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    rows = written(rows)
    counts = rows.groupBy("grade").count().limit(max_grades + 1).collect()
    if len(counts) > max_grades:
        raise ValueError(f"more than {max_grades} grades in {grade!r}")
    kept = rows.limit(0)
    for row in sorted(counts, key=lambda r: r["grade"]):
        own = rows.where(F.col("grade") == row["grade"])
        share = min(1.0, 1.2 * most_per_grade / row["count"])
        own = own.where(F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30)))
        kept = kept.unionByName(own.orderBy("order", "doc_id").limit(most_per_grade))
    sample = written(kept.select("doc_id", "grade"))
    discard(rows)
    return sample, {r["grade"]: r["count"] for r in counts}
