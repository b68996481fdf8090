"""Numbers for rows: dense ordinals without one task, prefixes, batches, and last-wins upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.scratch import written


def held(df: DataFrame, *without: str) -> Column:
    """A row in one column, ``_held``, so that whatever else a plan adds can't clash with its names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without)).alias("_held")


def numbered(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Adds a dense 0-based ordinal in the given order, without sorting all rows in one place; a column of that name is replaced.

    Rows are dealt by range and sorted; the counts of the ranges, one small row each, are summed up, and each
    range numbers its own. Equal rows may come in either order.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.select(held(df, name), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    joined = placed.join(F.broadcast(bases), "part")  # a row for each range: as many as partitions
    return joined.select("_held.*", (F.col("base") + F.col("at") - F.col("first")).alias(name))


def prefix(df: DataFrame, n: int | None, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows by a dense 0-based ordinal: all for None, none for 0 or less."""
    return df if n is None else df.where(F.col(ordinal) < n)


def batched(df: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``batch``: consecutive runs of ``size`` rows by ordinal; the last may be shorter. A column of that name is replaced."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return df.withColumn("batch", F.floor(F.col(ordinal) / size).cast("long"))


def last_wins(df: DataFrame, key: str | Column, *order: str | Column) -> DataFrame:
    """One row for each key: the last in the given order. A null key is a key."""
    best = Window.partitionBy(key).orderBy(*((F.col(c) if isinstance(c, str) else c).desc() for c in order))
    return df.select(held(df), F.row_number().over(best).alias("nth")).where("nth = 1").select("_held.*")


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` added to ``stored``; a row takes the place of one of its key. Columns that one side lacks are null."""
    both = stored.limit(0).unionByName(rows.limit(0), allowMissingColumns=True)
    side = lambda df, new: df.unionByName(both, allowMissingColumns=True).select(held(both), F.lit(new).alias("new"))
    return last_wins(side(stored, 0).unionByName(side(rows, 1)), F.col("_held")[key], "new").select("_held.*")
