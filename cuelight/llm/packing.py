"""Packing documents into sequences of a fixed capacity by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. What decides is only how many
pieces of each length there are: at most ``capacity`` numbers. For each kind of bin a subset-sum
over bitsets finds the fullest combination of available lengths that holds the longest one; it is
taken out as often as the counts allow, so that at least one length runs out each time and there are
at most ``capacity`` kinds of bins, whatever the corpus. The plan is made on the driver.

Pieces of a length are numbered without a sort or a shuffle of pieces: each task that makes pieces numbers its own, and the
counts of tasks are summed up. A number then tells the sequence and the place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.scratch import written
from cuelight.llm.tokens import Encoder, public_path

CAPACITY = 2048
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, nth[, ids]) of each document: its ids, then ``separator``, cut at ``capacity``.

    nth: how many pieces of that length the task made before.
    """
    ending = np.array([separator], "<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = _encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, batch.num_rows, 512):
                row, piece, length, crc, data = [], [], [], [], []
                for i, text in enumerate(texts.slice(lo, 512).to_pylist(), lo):
                    whole = encode(text or "") + ending
                    for k, at in enumerate(range(0, len(whole), step)):
                        part = whole[at : at + step]
                        row.append(i), piece.append(k), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if with_ids:
                            data.append(np.frombuffer(part, "<u4").astype(np.int32))
                number = pa.array(piece, pa.int32())
                out = [ids.take(pa.array(row, pa.int64())), number, pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
                out.append(pa.array(_running(np.array(length, np.int64), made)))
                if with_ids:
                    out.append(pa.array(data, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)
        encode.forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, schema)


def _running(length: np.ndarray, made: np.ndarray) -> np.ndarray:
    """For each piece the number of those of its length before it; ``made`` counts them and is brought up to date."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(length), np.int64)
    out[order] = made[ordered] + np.arange(len(length)) - first
    made += np.bincount(length, minlength=len(made))
    return out


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Of (length, count), longest first: (length, times) of a combination that fills ``room`` most.

    The bitset ``reach`` has bit s set if lengths so far can sum to s; counts are taken in powers of two.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, count in available:
        if length > room:
            continue
        left, chunk = min(count, room // length), 1
        while left and not reach >> room & 1:
            used = min(chunk, left)
            steps.append((length, used, reach))
            reach |= reach << (length * used) & mask
            left -= used
            chunk *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, used, before in reversed(steps):
        if not before >> total & 1:
            total -= length * used
            taken[length] = taken.get(length, 0) + used
    return sorted(taken.items(), reverse=True)


@dataclass
class PackingPlan:
    """Runs of the pieces of a length, in their numbering: piece ``first`` on of ``length`` goes to sequence
    ``sequence`` on, ``each`` to a sequence, from ``offset``. Sorted by length and first."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> PackingPlan:
    """counts: how many pieces there are of each length, 1 to capacity."""
    left = {length: n for length, n in sorted(counts.items(), reverse=True) if n}
    given = dict.fromkeys(left, 0)
    runs, sequence = [], 0
    while left:
        longest = next(iter(left))
        rest = [(length, n - (length == longest)) for length, n in left.items()]
        bin_ = dict.fromkeys([longest], 1)
        for length, n in fullest([(length, n) for length, n in rest if n], capacity - longest):
            bin_[length] = bin_.get(length, 0) + n
        times = min(left[length] // n for length, n in bin_.items())
        offset = 0
        for length, n in bin_.items():
            runs.append((length, given[length], sequence, n, offset))
            offset += length * n
            given[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return PackingPlan(*table.T, sequences=sequence)


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    Null texts count as empty and are one separator; rows that repeat an id are packed each; an empty table
    gives no rows. Other columns are ignored.
    """
    cut = pieces(docs, tokenizer or public_path("word_bpe_49k.json"), capacity, separator, with_ids)
    cut = written(cut.withColumn("task", F.spark_partition_id()))
    by_task = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan = minimum_bin_slack({r["length"]: r["n"] for r in histogram}, capacity)
    # A row for each task and length: Spark broadcasts them if they are few.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    columns = [c for c in cut.columns if c not in ("task", "nth")]
    numbered = cut.join(base, ["task", "length"]).select(*columns, (F.col("base") + F.col("nth")).alias("number"))
    span = int(plan.first.max(initial=0)) + 1
    keys = plan.length * span + plan.first if len(plan.length) else np.zeros(0, np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            run = np.searchsorted(keys, length * span + np.minimum(number, span - 1), "right") - 1
            k = number - plan.first[run]
            sequence = plan.sequence[run] + k // plan.each[run]
            offset = plan.offset[run] + k % plan.each[run] * length
            own = batch.drop_columns(["number"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sequence), pa.array(offset)], [*own.schema.names, "sequence_id", "offset"])

    return numbered.mapInArrow(placed, numbered.drop("number").schema.add("sequence_id", "long").add("offset", "long"))
