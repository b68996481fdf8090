"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt to parts, and in a part to blocks of ``BLOCK`` rows that lie in the
direction of the same sampled pivot. A block has a list for each dimension, sorted by
that component. For a query, sorted access goes down all lists at once, from the end that
its component favours; each row met is scored in full; and the sum of what the lists show
at that depth bounds all rows not met yet. The query is done with a block as soon as the
bound cannot beat its kth best so far (equal scores count by id, so an equal bound goes
on); a block whose bound is too low at the top is not touched. The kth best carries over
from block to block of a part, and parts are merged at the end.

Queries and candidates meet in a grid of blocks of queries and parts of candidates. Blocks are as
large as a task can hold, so that a candidate is sent as often as there are blocks, once for up to
``_QUERY_ROWS`` queries, and there are as many parts as keep the cores busy, so that a query is not sent
to more the more candidates there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm import vectors
from cuelight.scratch import written

BLOCK = 4096
_PART_ROWS = 8192  # at least, where there are that many
_QUERY_ROWS = 65_536
_CELLS_PER_CORE = 4
_PIVOTS = 64
_START = 4  # depth of the first descent; each further one is twice as long


class SortedLists:
    """A block of candidates (ids ascending where scores tie) with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(x, self.order.T, axis=0).T.copy()
        self.low, self.high = self.values[:, 0], self.values[:, -1]

    def search(self, q: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of ``best`` and this block."""
        scores, ids = best
        n = len(self.ids)
        used = np.flatnonzero(q)
        weight, order, values = q[used], self.order[used], self.values[used]
        bound = float(np.sum(np.maximum(weight * self.low[used], weight * self.high[used])))
        seen = np.zeros(n, bool)
        depth, step = 0, _START
        while depth < n:
            if len(scores) == k and scores[-1] > bound:
                break
            until = min(n, depth + step)
            if len(used):
                up = weight > 0
                rows = np.concatenate((order[up, n - until : n - depth].ravel(), order[~up, depth:until].ravel()))
                fresh = np.zeros(n, bool)
                fresh[rows] = True
                fresh &= ~seen
                seen |= fresh
                at = np.flatnonzero(fresh)
                bound = float(weight[up] @ values[up, n - until] + weight[~up] @ values[~up, until - 1])
            else:
                at, until, bound = np.arange(n), n, 0.0
            if len(at):
                own = self.x[at] @ q
                if len(scores) == k:
                    good = own >= scores[-1]
                    at, own = at[good], own[good]
                scores, ids = np.concatenate((scores, own)), np.concatenate((ids, self.ids[at]))
                keep = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[keep], ids[keep]
            depth, step = until, step * 2
        return scores, ids


def _scaled(raws: list[bytes], kind: str, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles that hold whole numbers, if inner products stay exact so; else as Python's integers."""
    x = np.floor(vectors.matrix(raws, kind) * scale)
    top = np.abs(x).max(initial=0.0)
    if top * top * x.shape[1] < 2.0**53:
        return x
    return _integers(x)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def grid(n: int, q: int, cores: int) -> tuple[int, int]:
    """Parts of ``n`` candidates and blocks of ``q`` queries."""
    blocks = ceil(q / _QUERY_ROWS)
    return max(1, min(ceil(n / _PART_ROWS), ceil(_CELLS_PER_CORE * cores / blocks))), blocks


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest integer inner product for each query.

    rows, queries: vec_id, embedding. Components become floor(scale * x). A query is a row of ``rows`` and its
    own row is no candidate; another row that repeats it is. Ties go to the smaller vec_id, null last. Vectors
    that are null, empty or hold null or non-finite components take no part, zero vectors do; vectors of other
    lengths are no candidates. A query row that comes twice is answered twice. Scores beyond a long are an error.
    """
    kind = vectors.element_type(rows)
    if vectors.element_type(queries) != kind:
        raise TypeError("queries and rows have components of different types")
    everything = written(vectors.encoded(rows, allow_zero=True).where("raw is not null"))
    asked = vectors.encoded(queries, allow_zero=True).where("raw is not null").groupBy("vec_id", "raw").agg(F.count("*").alias("times"))
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()))  # the table fixes the numbers
    n, q = everything.count(), asked.count()
    if not n or not q:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Pivots only decide which rows are neighbours in a block: a bounded sample does.
    pick = F.pmod(F.xxhash64("raw", F.lit(seed)), F.lit(max(1, n // (4 * _PIVOTS)))) == 0
    sample = [bytes(r[0]) for r in everything.where(pick).select("raw").limit(_PIVOTS).collect()]
    pivots = {size: vectors.matrix([r for r in sample if len(r) == size], kind) for size in set(map(len, sample))}
    parts, blocks = grid(n, q, rows.sparkSession.sparkContext.defaultParallelism)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            pivot = np.zeros(len(raws), np.int32)
            sizes = np.array([len(r) for r in raws])
            for size, p in pivots.items():
                own = np.flatnonzero(sizes == size)
                if len(own):
                    pivot[own] = (vectors.matrix([raws[i] for i in own], kind) @ p.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("raw"), pa.array(pivot)], ["vec_id", "raw", "pivot"])

    candidates = everything.mapInArrow(near, "vec_id long, raw binary, pivot int").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.expr(f"cast(pmod(xxhash64(vec_id, raw), {parts}) as int)").alias("part"),
        F.octet_length("raw").alias("size"),
        (F.col("pivot") + 1).alias("pivot"),
        F.lit(0).cast("long").alias("query"),
        "vec_id",
        "raw",
    )
    sent = asked.select(
        F.expr(f"cast(pmod(xxhash64(query), {blocks}) as int)").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.octet_length("raw").alias("size"),
        F.lit(0).alias("pivot"),
        "query",
        "vec_id",
        "raw",
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, known = None, None, {}
        held: list[pa.Table] = []

        def through(table: pa.Table) -> None:
            ids = table.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            x, q = _scaled(table.column("raw").to_pylist(), kind, scale), asking[1]
            if x.dtype != q.dtype:
                x, q = _integers(x), _integers(q)
            lists = SortedLists(ids, x)
            for i in range(len(q)):
                known[i] = lists.search(q[i], known.get(i, (np.zeros(0), np.zeros(0, np.int64))), k + 1)

        def result() -> Iterator[pa.RecordBatch]:
            if held:
                through(pa.concat_tables(held))
                held.clear()
            if not known:
                return
            query = np.repeat(asking[0], [len(known[i][0]) for i in range(len(asking[0]))])
            score = np.concatenate([known[i][0] for i in range(len(asking[0]))])
            ids = np.concatenate([known[i][1] for i in range(len(asking[0]))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(ids), pa.array([int(s) for s in score], pa.int64())], ["query", "vec_id", "score"]
            )

        for (block, part, size, pivot), table in vectors.grouped(batches, ["block", "part", "size", "pivot"]):
            if (block, part, size) != cell:
                yield from result()
                cell, asking, known = (block, part, size), None, {}
            if pivot == 0:
                asking = (
                    table.column("query").to_numpy(),
                    _scaled(table.column("raw").to_pylist(), kind, scale),
                )
                continue
            if asking is None:
                continue
            held.append(table)
            if sum(t.num_rows for t in held) >= BLOCK:
                whole = pa.concat_tables(held)
                held.clear()
                full = whole.num_rows // BLOCK * BLOCK
                for lo in range(0, full, BLOCK):
                    through(whole.slice(lo, BLOCK))
                if full < whole.num_rows:
                    held.append(whole.slice(full))
        yield from result()

    found = (
        candidates.unionByName(sent)
        .repartition("block", "part")
        .sortWithinPartitions("block", "part", "size", "pivot", "vec_id")
        .mapInArrow(searched, "query long, vec_id long, score long")
    )
    last = F.lit(int(np.iinfo(np.int64).max))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # Its own row is in the list if it is among the best; rows that repeat it look the same, and one goes.
    own = asked.select("query", F.col("vec_id").alias("query_id"), "times", norm(F.col("raw"), kind, scale).alias("norm"))
    found = found.join(own, "query")
    mine = (F.coalesce("query_id", last) == F.col("vec_id")) & (F.col("score") == F.col("norm"))
    found = found.withColumn("self", mine)
    found = found.withColumn("nth", F.sum(F.col("self").cast("int")).over(Window.partitionBy("query").orderBy("place")))
    kept = found.where(~(F.col("self") & (F.col("nth") == 1)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("place"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select(
        "query_id", "rank", F.when(F.col("vec_id") != last, F.col("vec_id")).alias("vec_id"), "score", F.explode(F.expr("sequence(1, cast(times as int))")).alias("_")
    ).drop("_")


def norm(raw: Column, kind: str, scale: float) -> Column:
    """The inner product of a vector with itself, as ``_scaled`` makes it."""

    def squared(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raws = column.to_pylist()
            sizes, out = np.array([len(r) for r in raws]), np.zeros(len(raws), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = _scaled([raws[i] for i in own], kind, scale)
                out[own] = (x * x).sum(1).astype(np.int64)
            yield pa.array(out)

    return F.arrow_udf(squared, "long")(raw)
