"""How far the sources of a language are from one another in their words, counted by DuckDB in shards of terms.

1. Each task counts the terms of its documents with SQL and lets (lang, source, term, occurrences, documents) out.
2. Counts are dealt to shards by lang and term. In a shard, SQL adds them up and keeps the terms that enough documents of
   the lang hold. Spark sums what groups and langs hold of kept terms.
3. With those sums each shard has all that a smoothed frequency needs: SQL adds up its part of the divergence of each pair
   of sources, of the terms that both have, and ranks its terms for each source.
4. Spark adds up the pairs' parts and ranks them, and ranks the shards' best terms.

A term that one source of a pair lacks adds f(p, q0), where q0 is the other's frequency of a term that it lacks: that depends
on the count alone, so terms are counted by their count, for each source, and shards never meet a term in a source without it:

    sum of f over kept terms = V f(p0, q0) + sum over A's terms [f(p, q0) - f(p0, q0)] + sum over B's terms [f(p0, q) - f(p0, q0)]
                               + sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

All numbers are whole: 128 bits in DuckDB, decimals in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.scratch import discard, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
_BATCH_ROWS = 4096
_BATCH_BYTES = 2 << 20
_TASK_ROWS = 1_500_000  # counts that a task holds before it adds them up
_HELD_ROWS = 200_000  # rows of whole shards that go into one query
_SHARD_ROWS = 50_000
_MEMORY = "512MB"  # of one task's DuckDB: an error beyond it, never a smaller result
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COUNT = f"""
    SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs
    FROM (SELECT doc, lang, source, term, count(*) AS n
          FROM (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM given)
          GROUP BY ALL)
    GROUP BY lang, source, term"""
_MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM given GROUP BY ALL"
_MERGE_SHARD = "SELECT shard, lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM given GROUP BY ALL"
_KEEP = """
    SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first
    FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM given GROUP BY ALL)
    QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}"""
_SHARED = """
    WITH own AS (
        SELECT lang, source, term, 1 + {scale} * (n::HUGEINT + 1) // (total + terms) AS p, 1 + {scale}::HUGEINT // (total + terms) AS p0 FROM given)
    SELECT 'pair' AS part, a.lang, a.source, b.source AS item,
           sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0
               - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)::DECIMAL(38, 0) AS value
    FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL"""
_TERMS = """
    WITH own AS (
        SELECT lang, source, term, 1 + {scale} * (n::HUGEINT + 1) // (total + terms) AS p,
               1 + {scale} * (sum(n) OVER (PARTITION BY lang, term) + 1) // (lang_total + terms) AS q
        FROM given)
    SELECT 'term' AS part, lang, source, term AS item, ((p - q) * (p - q) // q)::DECIMAL(38, 0) AS value
    FROM own WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) <= {most}"""


def _run(sql: str, given: pa.Table) -> pa.Table:
    """What a query makes of the rows of a shard, in memory, on the core of the task."""
    with duckdb.connect(config={"threads": 1, "memory_limit": _MEMORY, "temp_directory": ""}) as base:
        base.register("given", given)
        return base.sql(sql).to_arrow_table()


def _out(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches(max_chunksize=50_000)


_STRINGS = [(c, pa.string()) for c in ("lang", "source", "term")]
_COUNTS = pa.schema([*_STRINGS, ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = pa.schema([*_STRINGS, ("n", pa.int64()), ("first", pa.bool_())])
_PARTS = pa.schema([*[(c, pa.string()) for c in ("part", "lang", "source", "item")], ("value", pa.decimal128(38, 0))])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about _BATCH_BYTES of text; a longer text comes alone."""
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if i > lo and size + n > _BATCH_BYTES:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    yield batch.slice(lo)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch):
            made = _run(_COUNT, pa.Table.from_batches([part]).append_column("doc", pa.array(range(part.num_rows), pa.int64())))
            held.append(made.cast(_COUNTS))
            rows += made.num_rows
            if rows > _TASK_ROWS:
                merged = _run(_MERGE, pa.concat_tables(held)).cast(_COUNTS)
                held, rows = [merged], merged.num_rows
                if rows > _TASK_ROWS * 2 / 3:
                    yield from _out(merged, _COUNTS)
                    held, rows = [], 0
    if rows:
        yield from _out(_run(_MERGE, pa.concat_tables(held)), _COUNTS)


def _by_shard(batches: Iterator[pa.RecordBatch], sql: list[str], schema: pa.Schema, merge: str | None = None) -> Iterator[pa.RecordBatch]:
    """The results of queries over rows sorted by shard, some whole shards at a time. ``merge``: makes the rows of a shard that has
    more than fit fewer."""
    held: list[pa.Table] = []

    def results(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for query in sql:
            yield from _out(_run(query, rows.drop_columns(["shard"])), schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < _HELD_ROWS:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        shard = rows.column("shard").to_numpy()
        cut = int(shard.searchsorted(shard[-1]))
        if cut:
            yield from results(rows.slice(0, cut))
        rest = rows.slice(cut)
        if merge and rest.num_rows > _HELD_ROWS / 2:
            rest = _run(merge, rest)
        held = [rest]
    if held:
        yield from results(pa.concat_tables(held))


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), a long; 1 + SCALE at most."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square is at most 10^18 and stays a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source; other columns are not read).

    Part ``pair``: each other source of the lang, by its divergence from the source summed over the lang's terms. Part ``term``: the
    ``most_terms`` terms by which a source stands out most from its lang. Terms: runs of letters A to Z, lower-cased, and of anything
    beyond ASCII, that at least ``least_docs`` rows of the lang hold. Frequencies are smoothed by one, and in units of 1 / SCALE.

    Null texts, langs and sources count as empty ones, and an empty lang or source is one like any other. A source without terms has
    pairs as well. Repeated rows are rows of their own. Ties go by the item in byte order. An empty table gives an empty result. A text is one
    task's work: DuckDB holds about 60 bytes for each of its terms while it counts them.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = docs.select(*said)
    schema = "lang string, source string, term string, n long, docs long"
    counts = written(texts.mapInArrow(_counted, schema))
    groups = written(texts.select("lang", "source").distinct())
    # As many shards as keep each small, and some for each partition.
    spark = docs.sparkSession
    shards = max(-(-counts.count() // _SHARD_ROWS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard")
    dealt = lambda rows: rows.select(shard, "*").repartition("shard").sortWithinPartitions("shard")
    keep = _KEEP.format(least=int(least_docs))
    kept = written(
        dealt(counts).mapInArrow(lambda b: _by_shard(b, [keep], _KEPT, _MERGE_SHARD), "lang string, source string, term string, n long, first boolean")
    )
    discard(counts)
    inside = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = F.lit(0).cast("long")
    totals = groups.join(inside, ["lang", "source"], "left").join(of_lang, "lang", "left")
    totals = written(totals.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms"))))
    shared, terms = (q.format(scale=SCALE, most=int(most_terms)) for q in (_SHARED, _TERMS))
    parts = written(
        dealt(kept.join(totals, ["lang", "source"])).mapInArrow(
            lambda b: _by_shard(b, [shared, terms], _PARTS), "part string, lang string, source string, item string, value decimal(38,0)"
        )
    )
    # How many terms a source has of each count; a source's own langs are few, and so are the counts that occur.
    by_count = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    a = totals.select("lang", "source", "total", "terms")
    b = totals.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = a.join(b, "lang").where("source <> item")  # one row for each row of the result
    none_a, none_b = (_p(zero, F.col(t), F.col("terms")) for t in ("total", "item_total"))
    pairs = written(pairs.where("terms > 0").select("lang", "source", "item", "total", "item_total", "terms", none_a.alias("p0"), none_b.alias("q0")))
    base = _f(F.col("p0"), F.col("q0"))
    whole = lambda c: c.cast("decimal(38,0)")
    times = F.col("times").cast("decimal(18,0)")
    lacking_b = pairs.join(by_count, ["lang", "source"]).select(
        "lang", "source", "item", whole(times * (_f(_p(F.col("n"), F.col("total"), F.col("terms")), F.col("q0")) - base)).alias("value")
    )
    lacking_a = pairs.join(by_count.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", whole(times * (_f(F.col("p0"), _p(F.col("n"), F.col("item_total"), F.col("terms"))) - base)).alias("value")
    )
    constant = pairs.select("lang", "source", "item", whole(F.col("terms").cast("decimal(18,0)") * base).alias("value"))
    both = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    summed = constant.unionByName(lacking_b).unionByName(lacking_a).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    empty = a.where("terms = 0").join(b, "lang").where("source <> item").select("lang", "source", "item", whole(zero).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    of_pairs = summed.unionByName(empty).withColumns({"part": F.lit("pair"), "rank": F.row_number().over(ranked)}).select(*columns)
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
    return of_pairs.unionByName(best.select(*columns))
