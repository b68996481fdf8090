"""Vectors as bytes: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_type(df: DataFrame, column: str = "embedding") -> str:
    """numpy's name for the components: those of arrays of float stay 4 bytes."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{column} is {kind.simpleString()}, not an array")
    return "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"


def encoded(df: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id, raw) of each row: raw holds the components, or is null where the vector takes no part:
    null, of no component, with null or non-finite ones, or all zero unless ``allow_zero``. -0 counts as 0."""
    kind = element_type(df)
    width = int(kind[2])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            out: list[bytes | None] = []
            flat = column.flatten()  # of non-null lists
            gaps = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + 0.0
            bad = gaps | ~np.isfinite(values)
            wrong = np.concatenate(([0], np.cumsum(bad)))
            filled = np.concatenate(([0], np.cumsum(values != 0)))
            raw = values.astype(kind).tobytes()
            at = 0
            for n in column.value_lengths().to_pylist():
                n = n or 0
                ok = n > 0 and wrong[at + n] == wrong[at] and (allow_zero or filled[at + n] > filled[at])
                out.append(raw[at * width : (at + n) * width] if ok else None)
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "raw"])

    element = T.FloatType() if kind == "<f4" else T.DoubleType()
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(element)).alias("embedding")).mapInArrow(
        packed, "vec_id long, raw binary"
    )


def matrix(raws: list[bytes], kind: str) -> np.ndarray:
    """Rows of doubles from equally long vectors."""
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys of batches that are sorted by them, each as one table."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.zeros(n, bool)
        for c in columns:
            edges[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(edges).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[lo].item() for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows out of batches sorted by ``keys``, no group of equal keys cut in two; with each
    table the bounds of its groups."""
    held: list[pa.RecordBatch] = []
    count = 0

    def bounds(table: pa.Table) -> np.ndarray:
        edge = np.ones(table.num_rows + 1, bool)
        edge[1:-1] = False
        for k in keys:
            c = table.column(k).to_numpy()
            edge[1:-1] |= c[1:] != c[:-1]
        return np.flatnonzero(edge)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ends = bounds(table)
        if len(ends) > 2:
            yield table.slice(0, int(ends[-2])), ends[:-1]
            table = table.slice(int(ends[-2])).combine_chunks()
        held, count = table.to_batches(), table.num_rows
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)


def fixed_matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of doubles from a binary column of values of one length."""
    values = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    n = len(values)
    _, offsets, data = values.buffers()
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(offsets, wide, n + 1, values.offset * np.dtype(wide).itemsize)
    width = int(kind[2])
    flat = np.frombuffer(data, kind, int(ends[-1] - ends[0]) // width, int(ends[0]))
    return flat.reshape(n, -1).astype(np.float64)
