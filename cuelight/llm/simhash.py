"""SimHash near-duplicates, linked by a binary trie joined with itself.

1. Each text becomes a 64-bit fingerprint (majority of XXH64 bits over word shingles).
2. Equal fingerprints collapse to one node.
3. The 64 bits are cut into blocks. Two fingerprints that differ in at most
   ``max_bits`` places agree on some of the blocks, so every choice of that many
   blocks makes a table, and a pair meets in the trie below the shared blocks.
   More blocks are used as the corpus grows, so that tries stay small; the links
   found are the same.
4. In a task, the trie of each bucket is joined with itself: pairs of trie nodes go
   down together, differing bits add up, and a pair over the budget is dropped. A
   pair whose leaves are known to hang together already is dropped too. What comes
   out is one edge per fingerprint at most, never the pairs of a group.
5. Components of these edges give each document its class.

A bucket of more than ``CELL`` nodes is dealt as pairs of parts to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm import _text
from cuelight.scratch import discard, written
from cuelight.llm.components import component_ids, connected_components

CELL = 16_384
_BUCKET_AIM = 64
_FRONTIER = 400_000
_SLICE_ROWS = 65_536
_FEW_KEYS = 1_000_000  # of 16 bytes


def fingerprint(tokens: list[bytes], shingle: int, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles of ``tokens``; 0 if there are none."""
    n = len(tokens)
    if not n:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    first = np.concatenate(([0], ends[: n - shingle])).tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(first), 1 << 15):
        h = np.array(
            [digest(joined[p:q], seed) for p, q in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)],
            np.uint64,
        )
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp) of each row, longs of ``docs``; other columns are not read. Null text counts as empty.

    mark: a hash of the text, that tells rows of one id apart.
    """

    def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.zeros(len(column), np.uint64)
            for part in _text.slices(column):
                raw, ends = _text.lower_latin(part.data, ascii_only=True).tobytes(), part.ends.tolist()
                for i in range(part.count):
                    out[part.lo + i] = fingerprint(raw[ends[i] : ends[i + 1]].split(), shingle, seed)
            yield pa.array(out.view(np.int64))

    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.arrow_udf(hashed, "long")(text).alias("fp")
    )


def block_tables(nodes: int, max_bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Widths of the blocks and the choices of blocks that make the tables, by the number of nodes."""
    most = min(64, max_bits + 6)
    for blocks in range(max_bits + 1, most + 1):
        same = blocks - max_bits
        if nodes / 2 ** (64 * same / blocks) <= _BUCKET_AIM or blocks == most:
            break
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return widths, list(combinations(range(blocks), same))


def _fronted(widths: list[int], chosen: tuple[int, ...]) -> list[tuple[int, int]]:
    """(shift, width) of the blocks, from the top of the word, chosen ones first."""
    starts = np.concatenate(([0], np.cumsum(widths)))
    order = [*chosen, *(i for i in range(len(widths)) if i not in chosen)]
    return [(64 - int(starts[i]) - widths[i], widths[i]) for i in order]


def permuted(x: np.ndarray, moves: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(x)
    for shift, width in moves:
        out = (out << np.uint64(width)) | ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the classes of a[i] and b[i]; label[x] is then the smallest row of x's class. Labels point to smaller rows of it."""
    while True:
        deeper = label[label]
        if (deeper == label).all():
            break
        label[:] = deeper
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label[:] = deeper


def trie_classes(x: np.ndarray, group: np.ndarray, top: np.ndarray, max_bits: int) -> np.ndarray:
    """The class of each of the words ``x`` under links of at most ``max_bits`` differing bits inside groups.

    x and group are sorted by (group, x); words of a group are distinct and agree on their first ``top`` bits.
    The trie of a group is implicit: a node is a run lo:hi of words that share a prefix.
    """
    n = len(x)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[depth][hi] - ones[depth][lo])

    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi, start = lo[many], hi[many], top[edge[:-1]][many]
    stack = [(int(d), lo[m := start == d], hi[m], lo[m], hi[m], np.zeros(m.sum(), np.int8)) for d in np.unique(start)]
    while stack:
        depth, alo, ahi, blo, bhi, cost = stack.pop()
        if len(alo) > _FRONTIER:
            half = len(alo) // 2
            stack.append((depth, *(v[half:] for v in (alo, ahi, blo, bhi, cost))))
            alo, ahi, blo, bhi, cost = (v[:half] for v in (alo, ahi, blo, bhi, cost))
        # Nodes whose leaves all hang together already have nothing to add.
        runs = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        joined = (runs[alo] == runs[ahi - 1]) & (runs[blo] == runs[bhi - 1]) & (label[alo] == label[blo])
        keep = ~joined
        alo, ahi, blo, bhi, cost = (v[keep] for v in (alo, ahi, blo, bhi, cost))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = np.bitwise_count(x[a] ^ x[b]) <= max_bits
            _merge(label, a[near], b[near])
            alo, ahi, blo, bhi, cost = (v[~leaf] for v in (alo, ahi, blo, bhi, cost))
        if not len(alo) or depth >= 64:
            continue
        amid, bmid = split(alo, ahi, depth), split(blo, bhi, depth)
        own = alo == blo
        parts = [
            (alo, amid, blo, bmid, cost, None),
            (amid, ahi, bmid, bhi, cost, None),
            (alo, amid, bmid, bhi, cost + 1, None),
            (amid, ahi, blo, bmid, cost + 1, own),  # of a node with itself, the mirror image of the one before
        ]
        kept = []
        for a0, a1, b0, b1, c, mirrored in parts:
            ok = (a1 > a0) & (b1 > b0) & (c <= max_bits)
            ok &= ~((a0 == b0) & (a1 - a0 == 1))
            if mirrored is not None:
                ok &= ~mirrored
            kept.append(tuple(v[ok] for v in (a0, a1, b0, b1, c)))
        down = [np.concatenate(v) for v in zip(*kept, strict=True)]
        if len(down[0]):
            stack.append((depth + 1, *down))
    return label


def _cells(nodes: DataFrame, widths: list[int], tables: list[tuple[int, ...]]) -> DataFrame:
    """(t, key, cell, fp): each node in each table, and in a large bucket in each pair of parts that holds it."""

    def key(chosen: tuple[int, ...]) -> str:
        terms, left = [], sum(widths[i] for i in chosen)
        for shift, width in _fronted(widths, chosen)[: len(chosen)]:
            left -= width
            terms.append(f"shiftleft(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L, {left})")
        return " | ".join(terms)

    listed = ", ".join(f"named_struct('t', {t}, 'key', {key(c)})" for t, c in enumerate(tables))
    keyed = nodes.select("fp", F.explode(F.expr(f"array({listed})")).alias("e")).select("e.t", "e.key", "fp")
    large = written(keyed.groupBy("t", "key").count().where(F.col("count") > CELL))
    if large.isEmpty():
        return keyed.withColumn("cell", F.lit(0))
    parts = large.select("t", "key", F.ceil(F.col("count") / (CELL / 2)).cast("int").alias("parts"))
    dealt = keyed.join(parts, ["t", "key"], "left").withColumn("part", F.expr("cast(pmod(xxhash64(fp, 7), parts) as int)"))
    pair = "explode(transform(filter(sequence(0, parts - 1), j -> j <> part), j -> least(j, part) * parts + greatest(j, part)))"
    return dealt.where("parts is null").select("t", "key", "fp", F.lit(0).alias("cell")).unionByName(
        dealt.where("parts is not null").select("t", "key", "fp", F.expr(pair).alias("cell"))
    )


def trie_links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """nodes: distinct ``fp``. Returns edges (a, b) that connect exactly what links of up to ``max_bits`` bits connect."""
    widths, tables = block_tables(nodes.count(), max_bits)
    moves = [_fronted(widths, c) for c in tables]
    tops = np.array([sum(w for _, w in m[: len(tables[0])]) for m in moves])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "cell", "fp")]))
            rows = sum(h.shape[1] for h in held)
            if rows < _SLICE_ROWS:
                continue
            block = np.concatenate(held, axis=1)
            last = (block[:3] != block[:3, -1:]).any(0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = [block[:, cut:]]
            if cut:
                yield from edges(block[:, :cut])
        if held:
            yield from edges(np.concatenate(held, axis=1))

    def edges(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, fp = block[0], block[3].view(np.uint64)
        group = np.concatenate(([0], np.cumsum((block[:3, 1:] != block[:3, :-1]).any(0))))
        x = np.zeros(len(fp), np.uint64)
        for table in np.unique(t):
            x[t == table] = permuted(fp[t == table], moves[table])
        order = np.lexsort((x, group))
        label = trie_classes(x[order], group[order], tops[t[order]], max_bits)
        fp = fp[order].view(np.int64)
        found = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[found]), pa.array(fp[label[found]])], ["a", "b"])

    return (
        _cells(nodes, widths, tables)
        .select(F.col("t").cast("int"), F.col("key").cast("long"), F.col("cell").cast("long"), "fp")
        .repartition("t", "key", "cell")
        .sortWithinPartitions("t", "key", "cell")
        .mapInArrow(joined, "a long, b long")
    )


def _classes(docs: DataFrame, shingle: int, max_bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp) of each row of ``docs``; and (fp, class, component_id), the class named by one of its fingerprints."""
    rows = written(fingerprints(docs, shingle, seed))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = written(connected_components(trie_links(nodes.select("fp"), max_bits)))
    inside = component_ids(roots, nodes, "fp", "first_id").withColumnRenamed("node", "fp")
    label = nodes.join(inside, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("class"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    label = written(label)
    discard(nodes, roots)
    return rows, label


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    fingerprint: 16 hex digits. component_id: smallest doc_id that links of at most ``max_bits`` differing
    bits reach, the row's own included. Texts without a word, null ones too, have fingerprint 0 and link
    with each other. Rows that repeat a doc_id are rows of their own; rows without a doc_id link as any
    other does but never give their class its id. An empty table gives an empty result.
    """
    rows, label = _classes(docs, shingle, max_bits, seed)
    return rows.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each class, columns as they were: of the class's own texts, one of the smallest doc_id; of
    several texts of that id in the class, the one of the smallest fingerprint, then of the smallest hash; of rows that repeat
    id and text, the first by a hash of the whole row as JSON.

    Rows without a doc_id have no name to be told apart by; they are all kept. What is shuffled is ids and hashes: texts stay where they
    are, unless rows repeat both, or neither the rows that go nor those that stay are few enough to be sent to every task.
    """
    rows, label = _classes(docs, shingle, max_bits, seed)
    own = rows.join(label, "fp").where("doc_id = component_id")
    first = F.min(F.struct("doc_id", "fp", "mark")).alias("first")
    chosen = own.groupBy("class").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("mark"))
    named = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), "mark").agg(F.count("*").alias("rows"))
    # A key has a fate: it goes, stays as one row, or stays and has several rows of which one is taken.
    fate = F.when(F.col("chosen").isNull(), "goes").when(F.col("rows") == 1, "stays").otherwise("several")
    fates = named.join(chosen.distinct().withColumn("chosen", F.lit(True)), ["id", "mark"], "left").select("id", "mark", fate.alias("fate"))
    fates = written(fates)
    discard(rows, label)
    counts = {r["fate"]: r["count"] for r in fates.groupBy("fate").count().collect()}
    going, staying, several = (counts.get(f, 0) for f in ("goes", "stays", "several"))
    few = lambda wanted, n: F.broadcast(fates.where(wanted).select("id", "mark")) if n <= _FEW_KEYS else fates.where(wanted).select("id", "mark")
    # The row travels in one column, so that its names cannot clash.
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark")
    )
    if staying <= _FEW_KEYS < going + several:
        kept = whole.join(few("fate = 'stays'", staying), ["id", "mark"], "left_semi").select("row.*").unionByName(docs.where("doc_id is null"))
    else:
        kept = whole.join(few("fate <> 'stays'", going + several), ["id", "mark"], "left_anti").select("row.*")
    if not several:
        return kept
    again = whole.join(few("fate = 'several'", several), ["id", "mark"], "left_semi").groupBy("id", "mark")
    return kept.unionByName(again.agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*"))
