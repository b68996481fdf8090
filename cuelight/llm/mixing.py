"""Mixing sources to target weights by capped water-filling.

Each source has a weight and may be repeated at most ``max_epochs`` times. The words of
the whole corpus are shared by weight; a source whose share is above its cap is clamped
there and what it cannot take is shared again among the others by weight, until no
source is above its cap. A target of 2.4 times a source's size is two whole repetitions
of every document and one more of some of them, taken in a seeded order as long as they
fit into 0.4 of the source's words. What then remains is filled the same way by documents
further on that are no longer than it, ``ROUNDS`` times; at last, of all documents not taken yet the
one whose length is nearest to what is still missing is taken, if the source then comes nearer to its target.

Nothing is drawn: the order is the MD5 of seed and id, so reruns agree. The edge of a
source is found by sums of ranges of the order, then of ranges of the range at the edge, until
that holds few documents, so no task ever holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.scratch import discard, written

WORD = r"[^\x20\x09-\x0D]+"
_BROADCAST_BYTES = 4 << 20
ROUNDS = 3
_KEY_BITS, _RANGE_BITS = 60, 10  # ranges at a time: 1,024 rows at most that one task has of a source
_FEW = 4096  # rows of a range that are looked at one by one


def words(text: Column) -> Column:
    """Number of runs of bytes outside space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """60 bits of an MD5 of the seed and the id, of the text where there is no id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_weights(sources: DataFrame, cycle: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle's values in turn, over sources by code point, null last.

    ``sources`` has a row for each source: a catalogue, that one task can number.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (at % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", weight.cast("long"))


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words for each unit of weight once capped sources are clamped. ``sources``: source_size and weight, longs.

    The level only rises, and each round clamps another source or is the last.
    """
    cap = F.col("source_size") * max_epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weight if weight else 0.0
    while True:
        free = cap > F.lit(level) * F.col("weight")
        left, spent = sources.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, cap))).first()
        if not left:
            return level
        following = (total - (spent or 0)) / left
        if following <= level:
            return level
        level = following


def _small(table: DataFrame, name: str) -> bool:
    """Whether a table of sources may be broadcast, by its size; else Spark chooses."""
    rows, chars = table.agg(F.count("*"), F.sum(F.octet_length(name))).first()
    return rows * 64 + (chars or 0) <= _BROADCAST_BYTES


def _hint(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def _settled(table: DataFrame, small: bool) -> DataFrame:
    """A table of sources worked out once: through the driver if it is known to be small, else in the shared folder."""
    return table.sparkSession.createDataFrame(table.toArrow(), table.schema) if small else written(table)


def _edges(sized: DataFrame, needs: DataFrame, small: bool) -> DataFrame:
    """needs: of (source), after (key), most (size), need. Adds ``edge``: documents of keys over ``after`` and up to
    it, of a size up to ``most``, fit into ``need`` words together; and ``rest``: what they leave."""
    mine = F.col("source").eqNullSafe(F.col("of"))
    open_ = sized.join(_hint(needs, small), mine).where("key > after AND size <= most AND need > 0")
    earlier = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    own, shift = open_.withColumn("before", F.lit(0).cast("long")), _KEY_BITS
    seen: list[DataFrame] = []
    while True:
        shift -= _RANGE_BITS
        span = F.shiftrightunsigned("key", shift)
        spans = own.groupBy("source", "need", "before", span.alias("span")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        spans = spans.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        at = (
            spans.where(F.col("before") <= F.col("need")).groupBy("source")
            .agg(F.max_by(F.struct("span", "before", "rows"), "span").alias("r"))
            .select(F.col("source").alias("at"), F.col("r.span").alias("range"), F.col("r.before").alias("before"), F.col("r.rows").alias("rows"))
        )
        at = _settled(at, small)
        seen.append(at)
        own = open_.join(_hint(at, small), F.col("source").eqNullSafe(F.col("at")) & (span == F.col("range")))
        if shift == 0 or (at.agg(F.max("rows")).first()[0] or 0) <= _FEW:
            break
    edge = own.groupBy("source", "key", "need", "before").agg(F.sum("size").alias("words"))
    through = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    edge = edge.withColumn("through", through).where("through <= need").groupBy("source").agg(F.max("key").alias("last"), F.max("through").alias("taken"))
    edge = edge.select(F.col("source").alias("edge_of"), "last", "taken")
    found = needs.join(at, F.col("of").eqNullSafe(F.col("at")), "left").join(
        edge, F.col("of").eqNullSafe(F.col("edge_of")), "left"
    )
    # Without a fitting document in its range, the edge is where the range begins.
    stop = F.coalesce("last", F.shiftleft("range", shift) - 1, F.col("after"))
    taken = F.coalesce("taken", "before", F.lit(0))
    found = found.select("of", "after", "most", F.greatest(stop, "after").alias("edge"), (F.col("need") - taken).alias("rest"))
    found = _settled(found, small)
    discard(*seen)
    return found


def _once_more(more: Column, key: Column, size: Column) -> Column:
    return F.exists(more, lambda m: (key > m.after) & (key <= m.edge) & (size <= m.most))


def _nearest(sized: DataFrame, planned: DataFrame, small: bool) -> DataFrame:
    """planned: source, more, rest. (source, key) of the documents not taken once more that bring their source nearer to its
    target: those of the length nearest to ``rest``, the first in the order of several; rows that share a key go together."""
    left = sized.join(_hint(planned.withColumnRenamed("source", "of"), small), F.col("source").eqNullSafe(F.col("of")))
    left = left.where(F.col("rest") > 0).where(~_once_more(F.col("more"), F.col("key"), F.col("size")))
    away = F.abs(F.col("size") - F.col("rest"))
    best = left.groupBy("source").agg(F.min(F.struct(away.alias("away"), "key")).alias("best"))
    best = _settled(best.select(F.col("source").alias("at"), F.col("best.key").alias("best")), small)
    same = left.join(_hint(best, small), F.col("source").eqNullSafe(F.col("at")) & (F.col("key") == F.col("best")))
    taken = same.groupBy("source", "key", "rest").agg(F.sum("size").alias("words"))
    return taken.where(F.abs(F.col("words") - F.col("rest")) < F.col("rest")).select("source", "key")


def plan(sized: DataFrame, max_epochs: int = 3, cycle: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """sized: source, size, key. A row for each source: source_size, target, whole (repetitions of every document)
    and more, an array of (after, edge, most): documents with a key in (after, edge] and a size up to most get one more."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_weights(totals, cycle))
    small = _small(sources, "source")
    level = water_level(sources, max_epochs)
    sources = _settled(
        sources.withColumn("target", F.least(F.col("source_size").cast("double") * max_epochs, F.lit(level) * F.col("weight")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("whole", F.least("whole", F.lit(max_epochs)).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")),
        small,
    )
    needs = sources.select(
        F.col("source").alias("of"), F.lit(-1).cast("long").alias("after"), F.lit(float("inf")).alias("most"), "need"
    )
    out = sources.select("source", "source_size", "target", "whole", F.array().cast("array<struct<after:long,edge:long,most:double>>").alias("more"))
    for _ in range(ROUNDS):
        found = _edges(sized, needs, small)
        step = found.select(F.col("of").alias("_of"), F.array(F.struct("after", "edge", "most")).alias("_step"))
        out = out.join(step, F.col("source").eqNullSafe(F.col("_of")), "left")
        out = out.withColumn("more", F.concat("more", "_step")).drop("_of", "_step")
        needs = found.select("of", F.col("edge").alias("after"), F.col("rest").alias("most"), F.col("rest").alias("need"))
    out = _settled(out.join(needs.select("of", F.col("need").alias("rest")), F.col("source").eqNullSafe(F.col("of"))).drop("of"), small)
    nearest = _nearest(sized, out.select("source", "more", "rest"), small).select(F.col("source").alias("of"), "key")
    step = F.array(F.struct((F.col("key") - 1).alias("after"), F.col("key").alias("edge"), F.lit(float("inf")).alias("most")))
    out = out.join(nearest, F.col("source").eqNullSafe(F.col("of")), "left")
    return _settled(out.withColumn("more", F.when(F.col("key").isNull(), F.col("more")).otherwise(F.concat("more", step))).drop("of", "key", "rest"), small)


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, key) of each row; null text has no word."""
    return written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(seed).alias("key")))


def repetitions(docs: DataFrame, planned: DataFrame, size: Column, key: Column) -> DataFrame:
    """(row, source_size, target, times) of each row of ``docs``: the row in one column, so that no name can clash, and
    how often it is taken. ``size`` and ``key``: expressions over ``docs`` as ``sizes`` has them."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    placed = docs.select(row, F.col("source").alias("from"), size.alias("words"), key.alias("at"))
    joined = placed.join(_hint(planned, _small(planned, "source")), F.col("from").eqNullSafe(F.col("source")))
    more = _once_more(F.col("more"), F.col("at"), F.col("words"))
    return joined.select("row", "source_size", "target", (F.col("whole") + more.cast("long")).alias("times"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 0, cycle: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken, columns as they were, whatever their names.

    Needs doc_id, text and source. Rows that repeat an id are taken alike; a null source is a source; an
    empty table gives an empty mixture.
    """
    planned = plan(sizes(docs, seed), max_epochs, cycle)
    taken = repetitions(docs, planned, words(F.col("text")), order_key(seed)).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
