"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector belongs to it if their inner product exceeds a
threshold. Directions are a structured random product code: a seeded rotation, the
coordinates cut into blocks, a small random codebook for each block, and every
concatenation of one codeword from each is a filter. Which filters a vector exceeds is
list-decoded block by block: a partial sum that cannot reach the threshold any more is
dropped, so the filters are never enumerated. A vector under too few caps gets its best ones.

Vectors are joined on filters and verified by their cosine in double precision. A row is a vector under one
filter, so bytes grow with the filters of a vector, not with their square. A pair
that meets under several filters counts under the first both have: for vectors with links their filters are worked out again. Equal vectors are one
node with a count. Sums of links and a spanning forest of each bucket come out of a
task, never pairs, and a bucket over ``CELL`` vectors is dealt as pairs of its parts.

The threshold is the height of a cap that holds the vectors aimed at. The more vectors, the
narrower the caps, and the fewer of them two near vectors share: filters and bucket sizes grow
until planted pairs at the least cosine meet often enough, by trial on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm import vectors
from cuelight.scratch import discard, written
from cuelight.llm.components import component_ids, connected_components
from cuelight.llm.simhash import _merge

CELL = 2048
_BUCKET_AIM = 48
_CODEBOOK = 256  # codewords of a block at most
_WHOLE = 2.0**20
_PLANTED, _MEET = 4096, 0.96  # pairs to try a code with, and the share of them that must meet


@dataclass
class ProductCode:
    rotation: np.ndarray
    codebooks: list[np.ndarray]
    threshold: float
    fewest: int  # filters that each vector gets at least

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of unit vectors, ascending. All over the threshold, at least ``fewest`` if there are.

        Products are of whole numbers that a double holds exactly, so a vector has the same filters in whatever company it is decoded.
        """
        turned = np.rint(np.rint(units * _WHOLE) @ np.rint(self.rotation * _WHOLE) / _WHOLE)
        scores, at = [], 0
        for book in self.codebooks:
            scores.append(turned[:, at : at + book.shape[1]] @ np.rint(book * _WHOLE).T / (_WHOLE * _WHOLE))
            at += book.shape[1]
        rest = np.concatenate((np.cumsum([s.max(1) for s in scores[::-1]], axis=0)[::-1], np.zeros((1, len(units)))))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
        todo, bar = np.arange(len(units)), np.full(len(units), self.threshold)
        while len(todo):
            row, total, code = todo, np.zeros(len(todo)), np.zeros(len(todo), np.int64)
            for i, s in enumerate(scores):
                size = s.shape[1]
                sums = total[:, None] + s[row]
                ok = sums + rest[i + 1][row][:, None] >= bar[row][:, None]
                a, b = np.nonzero(ok)
                row, total, code = row[a], sums[a, b], code[a] * size + b
            order = np.lexsort((code, row))
            row, code, total = row[order], code[order], total[order]
            bounds = np.searchsorted(row, np.concatenate((todo, [len(units)])))
            few = []
            for v, lo, hi in zip(todo.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < self.fewest and bar[v] > -1:
                    few.append(v)
                elif bar[v] < self.threshold and hi - lo > self.fewest:
                    best = np.argsort(-total[lo:hi], kind="stable")[: self.fewest]
                    out[v] = np.sort(code[lo:hi][best])
                else:
                    out[v] = code[lo:hi]
            todo = np.array(few, np.int64)
            bar[todo] = np.where(bar[todo] > self.threshold / 4, bar[todo] - self.threshold / 8, -9.0)
        return out


def cap_height(share: float, dimension: int) -> float:
    """The inner product that a ``share`` of the unit sphere exceeds with any one direction."""
    angle = np.linspace(0, pi, 100_001)
    density = np.sin(angle) ** (max(dimension, 2) - 2)
    below = np.concatenate(([0.0], np.cumsum(density[1:] + density[:-1])))
    return float(np.cos(np.interp(share, below / below[-1], angle)))


def _code(count: int, dimension: int, filters: int, aim: int, seed: int) -> ProductCode:
    """About ``filters`` caps over each of ``count`` vectors, about ``aim`` vectors under each."""
    rng = np.random.default_rng([seed, dimension])
    rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    share = min(0.25, aim / max(count, 1))
    total = max(1.0, filters / share)
    blocks = min(dimension, max(1, ceil(log(total) / log(_CODEBOOK))))
    size = max(2, round(total ** (1 / blocks)))
    books = []
    for width in [dimension // blocks + (i < dimension % blocks) for i in range(blocks)]:
        book = rng.standard_normal((size, width))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * sqrt(width / dimension))
    return ProductCode(rotation, books, cap_height(share, dimension), max(2, filters // 2))


def planted_recall(code: ProductCode, dimension: int, least: float, pairs: int = _PLANTED, seed: int = 1) -> float:
    """The share of random pairs of cosine ``least`` that meet under a filter."""
    rng = np.random.default_rng([seed, dimension])
    x = rng.standard_normal((pairs, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((pairs, dimension))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)  # in one dimension nothing is left
    y = least * x + sqrt(max(0.0, 1 - least * least)) * z
    met = 0
    for lo in range(0, pairs, 128):
        both = zip(code.decode(x[lo : lo + 128]), code.decode(_units(y[lo : lo + 128])), strict=True)
        met += sum(len(np.intersect1d(a, b)) > 0 for a, b in both)
    return met / pairs


def product_code(count: int, dimension: int, filters: int = 20, seed: int = 7, least: float = 0.9) -> ProductCode:
    """A code for ``count`` vectors: ``filters`` caps over each and ``_BUCKET_AIM`` vectors under each, more of
    both until pairs of cosine ``least`` meet often enough. Where that is no less than all pairs, one cap is over all."""
    aim = _BUCKET_AIM
    while filters * aim < count:
        code = _code(count, dimension, filters, aim, seed)
        if planted_recall(code, dimension, least) >= _MEET:
            return code
        filters, aim = ceil(filters * 1.25), min(CELL // 2, aim * 3 // 2)
    return ProductCode(np.eye(dimension), [np.zeros((1, dimension))], -1.0, 1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shared(lists: list[np.ndarray], before: int) -> np.ndarray:
    """Whether two vectors have a filter in common that comes before one, for all pairs of some vectors."""
    row = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    every = np.concatenate(lists)
    row, every = row[every < before], every[every < before]
    _, which, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[which] > 1
    _, which = np.unique(which[keep], return_inverse=True)
    member = np.zeros((len(lists), int(which.max(initial=-1)) + 1), np.float32)
    member[row[keep], which] = 1
    return member @ member.T > 0


def cap_links(nodes: DataFrame, kind: str, least: float = 0.9, filters: int = 20, seed: int = 7, max_lengths: int = 4096) -> DataFrame:
    """nodes: node long, raw, copies. Rows (a, b, links): an edge of a spanning forest where b is set, else ``links``
    to add to the count of node a, copies of its neighbours included.

    Vectors of each length have a code of their own, which the driver chooses and every task gets: ``max_lengths`` bounds
    them, and a table of more is an error, not a smaller result.
    """
    dims = {r[0]: r[1] for r in nodes.groupBy(F.octet_length("raw")).count().limit(max_lengths + 1).collect()}
    if len(dims) > max_lengths:
        raise ValueError(f"more than {max_lengths} different numbers of components")
    width = int(kind[2])
    codes = {bytes_: product_code(n, bytes_ // width, filters, seed, least) for bytes_, n in dims.items()}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raws = part.column("raw").to_pylist()
                lists: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raws)
                for size in set(map(len, raws)):
                    own = [i for i, r in enumerate(raws) if len(r) == size]
                    for i, found in zip(own, codes[size].decode(_units(vectors.matrix([raws[i] for i in own], kind))), strict=True):
                        lists[i] = found
                row = np.repeat(np.arange(len(raws)), [len(f) for f in lists])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([len(r) for r in raws], np.int32)[row]),
                        pa.array(np.concatenate(lists) if len(row) else np.zeros(0, np.int64)),
                        *(part.column(c).take(take) for c in ("node", "raw", "copies")),
                    ],
                    ["size", "filter", "node", "raw", "copies"],
                )

    schema = "size int, filter long, node long, raw binary, copies long"
    under = nodes.select("node", "raw", "copies").mapInArrow(decoded, schema)
    # Buckets are counted first; large ones are few and get a grid of cells.
    counts = under.groupBy("size", "filter").count().where(F.col("count") > CELL)
    large = written(counts.select("size", "filter", F.ceil(F.col("count") / (CELL / 2)).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = under.withColumns({"cell": F.lit(0).cast("long"), "part": F.lit(0), "across": F.lit(False)})
    else:
        joined = under.join(large, ["size", "filter"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        joined = joined.withColumn("part", F.expr("cast(pmod(xxhash64(node, 11), parts) as int)"))
        cells = "explode(transform(sequence(0, parts - 1), j -> cast(least(j, part) as long) * parts + greatest(j, part)))"
        dealt = joined.withColumn("cell", F.expr(cells)).withColumn("across", F.expr("cell div parts <> cell % parts")).drop("parts")

    rows_at_once = max(256, (16 << 20) // (8 * max([b // width for b in dims], default=1)))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in vectors.whole_groups(batches, ["size", "filter", "cell"], rows_at_once):
            size = table.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # vectors of one length at a time
                yield from block(table.slice(lo, hi - lo), bounds[(bounds >= lo) & (bounds <= hi)] - lo)

    def block(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        u = _units(vectors.fixed_matrix(table.column("raw"), kind))
        code = codes[len(table.column("raw")[0].as_py())]
        known: dict[int, np.ndarray] = {}  # filters of the vectors that have links here
        cap, part, across, node, copies = (table.column(c).to_numpy() for c in ("filter", "part", "across", "node", "copies"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            near = u[lo:hi] @ u[lo:hi].T >= least
            if across[lo]:
                near &= part[lo:hi, None] != part[None, lo:hi]
            elif np.count_nonzero(near) <= hi - lo:  # each with itself
                continue
            a, b = np.nonzero(np.triu(near, 1))
            if not len(a):
                continue
            used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            n, x, y = len(used), at[: len(a)], at[len(a) :]
            names = node[lo + used].tolist()
            new = [i for i, name in enumerate(names) if name not in known]
            for at_once in range(0, len(new), 256):
                some = new[at_once : at_once + 256]
                for i, caps in zip(some, code.decode(u[lo + used[some]]), strict=True):
                    known[names[i]] = caps
            lists = [known[name] for name in names]
            first = ~_shared(lists, cap[lo])[x, y]  # of the filters that both have, this is the first
            who, many = node[lo + used], copies[lo + used]
            links = np.bincount(x[first], many[y[first]], n) + np.bincount(y[first], many[x[first]], n)
            label = near[np.ix_(used, used)].argmax(1)  # its first neighbour; what is left is merged pair by pair
            label = np.minimum(label, np.arange(n))
            _merge(label, x, y)
            tied, counted = np.flatnonzero(label != np.arange(n)), np.flatnonzero(links)
            out.append((who[tied], who[label[tied]], np.zeros(len(tied), np.int64)))
            counts.append((who[counted], links[counted].astype(np.int64)))
        if out:
            a = np.concatenate([o[0] for o in out] + [c[0] for c in counts])
            b = pa.concat_arrays([pa.array(np.concatenate([o[1] for o in out])), pa.nulls(len(a) - sum(len(o[1]) for o in out), pa.int64())])
            links = np.concatenate([o[2] for o in out] + [c[1] for c in counts])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(links)], ["a", "b", "links"])

    return (
        dealt.repartition("size", "filter", "cell")
        .sortWithinPartitions("size", "filter", "cell")
        .mapInArrow(verified, "a long, b long, links long")
    )


def near_duplicates(rows: DataFrame, least: float = 0.9, filters: int = 20, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, embedding; other columns are ignored).

    Pairs count as linked if they meet under a filter and their cosine is at least ``least``, whatever else
    the rows hold; equal vectors always do. Null, empty and zero vectors and those with null or non-finite
    components link with nothing, and vectors of different lengths never do. Rows that repeat an id count
    each. An empty table gives an empty result.
    """
    kind = vectors.element_type(rows)
    read = written(vectors.encoded(rows, allow_zero=False))
    valid = read.where("raw is not null")
    nodes = valid.groupBy("raw").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))  # the table fixes the numbers
    found = written(cap_links(nodes, kind, least, filters, seed))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = written(connected_components(found.where("b is not null").select("a", "b")))
    inside = component_ids(roots, nodes, "node", "first_id").drop("root")
    facts = nodes.join(links, "node", "left").join(inside, "node", "left").select(
        "raw",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first_id").alias("component"),
    )
    facts = written(facts)
    discard(nodes, found, roots)
    known = valid.join(facts, "raw").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = read.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
