"""Lines of files, each with its place, as a data source whose partitions are ranges of bytes.

A line belongs to the range that it begins in, so a file of any size is read by many tasks, each line once. Spark has no order of
lines; here a line knows its file, its range and its number within the range, and sums of the ranges' counts make numbers of lines. A
prefix needs no more than the ranges that it lies in: counts are taken range by range, twice as many each time, until there are enough.

Ranges are read where Arrow's file systems reach the file. A file compressed as .gz, .bz2 or .zst is one range, read from its beginning on. Files of other systems, and those compressed
otherwise, come from Spark's text reader with the same columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuelight.operators.numbering import held
from cuelight.scratch import written

LINES = "file string, start long, row long, nth long, run long, line binary"
COUNTS = "file string, start long, lines long, nonblank long, runs long, opens boolean, closes boolean"
_STREAMED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
_COMPRESSED = (".lz4", ".snappy", ".deflate", ".xz")
_BATCH_LINES, _BATCH_BYTES = 10_000, 1 << 20
_CHUNK = 1 << 20
_SEPARATORS = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"  # what counts as white space in ASCII
_FEW_RANGES = 100_000


@dataclass(frozen=True)
class Range:
    """Bytes start to end of a file; ``take``: so many lines that aren't blank, and no more, or all if it is negative."""

    file: str
    start: int
    end: int
    take: int = -1


@dataclass
class Ranges(InputPartition):
    own: list[Range]


def _read(file: pa.NativeFile, start: int, end: int) -> tuple[bytes, int]:
    """The bytes of a piece of a file, from the one before it, to the end of the line that begins last in it; and where they begin. Nothing if no line begins."""
    first = max(0, start - 1)
    file.seek(first)
    parts = [file.read(end - first)]
    if start and b"\n" not in parts[0] and b"\r" not in parts[0]:
        return b"", first
    last = parts[0][-1:]
    while last and last not in b"\r\n":
        more = file.read(_CHUNK)
        ends = [i for i in (more.find(b"\n"), more.find(b"\r")) if i >= 0]
        parts.append(more[: min(ends) + 1] if ends else more)
        if ends or not more:
            break
    return b"".join(parts), first


def cut_lines(data: bytes, first: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``data``, whose first byte is byte ``first`` of a file, the lines of the range start to end begin and end. A line ends at \\n, \\r\\n or \\r."""
    codes = np.frombuffer(data, np.uint8)
    feed, back = codes == 10, codes == 13
    stops = feed.copy()
    stops[:-1] |= back[:-1] & ~feed[1:]
    stops[-1:] |= back[-1:]
    stop = np.flatnonzero(stops)
    begin = stop + 1
    if start == 0:
        begin = np.concatenate(([0], begin))
    begin = begin[(begin >= start - first) & (begin < min(end - first, len(data)))]
    at = np.searchsorted(stop, begin)
    close = np.concatenate((stop, [len(data)]))[at]
    after_return = (close > begin) & (close < len(data)) & feed[np.minimum(close, len(data) - 1)] & back[close - 1]
    return begin, close - after_return


def _codec(name: str) -> str | None:
    """How a file that is read as a stream is compressed."""
    return next((codec for end, codec in _STREAMED.items() if name.lower().endswith(end)), None)


def _cut_pieces(at: Range) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """A range by pieces that hold whole lines: bytes, and where the lines that begin in a piece begin and end in them."""
    system, path = fs.FileSystem.from_uri(at.file)
    with system.open_input_file(path) as file:
        for start in range(at.start, at.end, _CHUNK):
            end = min(at.end, start + _CHUNK)
            data, first = _read(file, start, end)
            yield data, *cut_lines(data, first, start, end)


def _streamed_pieces(at: Range) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The same of a whole compressed file."""
    system, path = fs.FileSystem.from_uri(at.file)
    with system.open_input_stream(path, compression=_codec(path)) as file:
        held: list[bytes] = []
        while more := file.read(_CHUNK):
            stop = max(more.rfind(b"\n"), more.rfind(b"\r", 0, len(more) - 1)) + 1  # a return at the end may have its feed in the next piece
            if stop:
                data = b"".join([*held, more[:stop]])
                yield data, *cut_lines(data, 0, 0, len(data))
                held = []
            held.append(more[stop:])
        if data := b"".join(held):
            yield data, *cut_lines(data, 0, 0, len(data))


def pieces_of(at: Range) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """A range a piece at a time: how many lines begin in the piece, and number in it and bytes of those that aren't blank. A byte order mark before the first is
    dropped. What is held is a piece, or one longer line."""
    fresh = at.start == 0
    for data, begin, close in _streamed_pieces(at) if _codec(at.file) else _cut_pieces(at):
        marked, fresh = fresh and data[:3] == b"\xef\xbb\xbf", False
        if not data or marked and len(data) == 3:
            continue
        if marked and len(begin):
            begin[0] = min(3, int(close[0]))
        lines = [data[a:b] for a, b in zip(begin.tolist(), close.tolist(), strict=True)]
        full = [i for i, line in enumerate(lines) if line.strip() and (line.isascii() or line.decode(errors="replace").strip()) and line.strip(_SEPARATORS)]
        yield len(lines), full, [lines[i] for i in full]


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.count = options["mode"] == "counts"
        self.groups = [[Range(*r) for r in group] for group in json.loads(options["ranges"])]

    def partitions(self) -> list[Ranges]:
        return [Ranges(group) for group in self.groups]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for at in partition.own:
            total = nth = 0
            run, before, opens = 0, None, False
            for n, full, lines in pieces_of(at):
                rows = np.array(full, np.int64) + total
                total += n
                if not len(rows):
                    continue
                opens |= before is None and rows[0] == 0
                gaps = np.diff(rows, prepend=rows[0] - 1 if before is None else before) > 1
                runs, before = run + np.cumsum(gaps), int(rows[-1])
                run, first, nth = int(runs[-1]), nth, nth + len(rows)
                if self.count:
                    continue
                most = len(rows) if at.take < 0 else min(at.take - first, len(rows))
                for lo, hi in _batches(lines[:most]):
                    arrays = [np.full(hi - lo, at.start), rows[lo:hi], np.arange(first + lo, first + hi), runs[lo:hi]]
                    columns = [pa.array([at.file] * (hi - lo), pa.string()), *(pa.array(c, pa.int64()) for c in arrays), pa.array(lines[lo:hi], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "start", "row", "nth", "run", "line"])
                if 0 <= at.take <= nth:
                    break
            if self.count:
                counts = [at.file, at.start, total, nth, run + 1 if nth else 0, bool(opens), before is not None and before == total - 1]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in counts], ["file", "start", "lines", "nonblank", "runs", "opens", "closes"])


def _batches(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Where runs of lines of about _BATCH_BYTES begin and end; a longer line comes alone."""
    lo = size = 0
    for i, line in enumerate(lines):
        if i > lo and (size + len(line) > _BATCH_BYTES or i - lo >= _BATCH_LINES):
            yield lo, i
            lo, size = i, 0
        size += len(line)
    if lo < len(lines):
        yield lo, len(lines)


class LinesSource(DataSource):
    """Options: mode, ``lines`` or ``counts``, and ranges, JSON of a list of each partition's ranges."""

    @classmethod
    def name(cls) -> str:
        return "cuelight_lines"

    def schema(self) -> str:
        return COUNTS if self.options["mode"] == "counts" else LINES

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files of a path, a folder or a pattern, in order of their names; hidden ones are left out."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(root) or []:
        if status.isFile():
            found.append((status.getPath().toUri().toString(), status.getLen()))
            continue
        inside, prefix = system.listFiles(status.getPath(), True), len(status.getPath().toUri().toString())
        while inside.hasNext():
            one = inside.next()
            name = one.getPath().toUri().toString()
            if not any(part.startswith(("_", ".")) for part in name[prefix:].strip("/").split("/")):
                found.append((name, one.getLen()))
    if not found and not (system.globStatus(root) or []):
        raise FileNotFoundError(f"no file at {path}")
    return sorted(found)


def _address(uri: str) -> str:
    """A Hadoop path as Arrow has it."""
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _reachable(files: list[tuple[str, int]]) -> bool:
    try:
        return all(fs.FileSystem.from_uri(uri) for uri in {_address(name).rpartition("/")[0] + "/" for name, _ in files}) and not any(
            name.lower().endswith(_COMPRESSED) for name, _ in files
        )
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False


def _size(spark: SparkSession) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def _cut(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(_address(name), lo, total if _codec(name) else min(total, lo + size)) for name, total in files if total for lo in range(0, total, total if _codec(name) else size)]


def _load(spark: SparkSession, ranges: list[Range], mode: str, size: int) -> DataFrame:
    """Small ranges share a partition."""
    groups: list[list[Range]] = []
    room = 0
    for r in ranges:
        if room < r.end - r.start:
            groups.append([])
            room = size
        groups[-1].append(r)
        room -= r.end - r.start
    spark.dataSource.register(LinesSource)
    given = json.dumps([[[r.file, r.start, r.end, r.take] for r in group] for group in groups or [[]]])
    return spark.read.format(LinesSource.name()).option("mode", mode).option("ranges", given).load()


def _prefix(spark: SparkSession, ranges: list[Range], limit: int, size: int) -> list[Range]:
    """The ranges that hold the first ``limit`` lines that aren't blank; the last is read up to them."""
    kept: list[Range] = []
    at, wave, left = 0, 1, limit
    while left > 0 and at < len(ranges):
        own = ranges[at : at + wave]
        counts = {(r["file"], r["start"]): r["nonblank"] for r in _load(spark, own, "counts", size).collect()}  # a row for each range
        for r in own:
            if left <= 0:
                break
            n = counts[r.file, r.start]
            kept.append(Range(r.file, r.start, r.end, min(n, left)))
            left -= n
        at, wave = at + wave, wave * 2
    return kept


_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def _numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, row, full, value) of all lines by Spark's reader: those of a block are numbered in one task each."""
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    rows = read.withColumn("row", F.row_number().over(Window.partitionBy("file", "start").orderBy("at")).cast("long") - 1)
    marked = F.when((F.col("start") == 0) & (F.col("row") == 0), F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return rows.select("file", "start", "row", marked.alias("value")).withColumn("full", ~F.col("value").rlike(_BLANK))


def _by_text_reader(spark: SparkSession, path: str) -> DataFrame:
    """The same columns by Spark's reader."""
    own = Window.partitionBy("file", "start").orderBy("row")
    rows = _numbered_text(spark, path).where("full").withColumn("fresh", F.col("row") > F.lag("row").over(own) + 1)
    nth, run = F.row_number().over(own).cast("long") - 1, F.count_if("fresh").over(own)
    return rows.select("file", "start", "row", nth.alias("nth"), run.alias("run"), F.col("value").cast("binary").alias("line"))


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(file, start, row, nth, run, line) of the lines that aren't blank: (file, start, row) orders them as they stand in the files, files by name; ``row`` counts all
    lines of a range from 0, ``nth`` those that aren't blank, ``run`` the runs of lines without a blank one between them. ``limit``: the first so many, none for 0 and less; what lies beyond is not read,
    but for the ranges' ends."""
    files = _files(spark, path)
    if not _reachable(files):
        rows = _by_text_reader(spark, path)
        return rows if limit is None else rows.join(F.broadcast(_first(rows, limit)), ["file", "start"]).where("nth < take").drop("take")
    size = _size(spark)
    ranges = _cut(files, size)
    return _load(spark, ranges if limit is None else _prefix(spark, ranges, limit, size), "lines", size)


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """(file, start, take) for each block: a row for a block, which the driver could hold."""
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("file", "start", (F.lit(max(0, limit)) - earlier).alias("take"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, lines, nonblank, runs, opens, closes) of each range: its lines, those that aren't blank, the runs that these make, and whether its first and last
    line aren't blank."""
    files = _files(spark, path)
    if _reachable(files):
        size = _size(spark)
        return _load(spark, _cut(files, size), "counts", size)
    rows = _numbered_text(spark, path)
    fresh = F.col("full") & ~F.coalesce(F.lag("full").over(Window.partitionBy("file", "start").orderBy("row")), F.lit(False))
    return rows.withColumn("fresh", fresh).groupBy("file", "start").agg(
        F.count("*").alias("lines"), F.count_if("full").alias("nonblank"), F.count_if("fresh").alias("runs"), F.min_by("full", "row").alias("opens"), F.max_by("full", "row").alias("closes")
    )


def line_number(spark: SparkSession, path: str, file: str, start: int, row: int) -> int:
    """The 1-based number of a line in its file. Of the path only that file's ranges before it are counted."""
    own = [f for f in _files(spark, path) if _address(f[0]) == _address(file)]
    counts = count_lines(spark, own[0][0] if own else path)
    return int(counts.where((F.col("file") == file) & (F.col("start") < start)).agg(F.sum("lines")).first()[0] or 0) + row + 1


def with_line_numbers(rows: DataFrame, path: str, through_files: bool = False, name: str = "line_number") -> DataFrame:
    """Adds the 1-based number of each line in its file, blank lines counted, or in all files of the path as if they were one. ``rows``: as ``read_json_lines``
    makes them, all or some. Sums of the ranges' counts are joined to them."""
    of = Window.orderBy("file", "start") if through_files else Window.partitionBy("file").orderBy("start")
    earlier = F.coalesce(F.sum("lines").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(count_lines(rows.sparkSession, path)).select(F.col("file").alias("_file"), F.col("start").alias("_start"), earlier.alias("_base"))  # a row for each range
    few = bases.count() <= _FEW_RANGES
    met = rows.select(held(rows, name)).join(
        F.broadcast(bases) if few else bases, (F.col("_held.position.file") == F.col("_file")) & (F.col("_held.position.block") == F.col("_start"))
    )
    return met.select("_held.*", (F.col("_base") + F.col("_held.position.row") + 1).alias(name))


def in_order(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Adds dense 0-based numbers in file order, by sums of what the ranges hold; rows stay where they are. ``rows``: position, as ``read_json_lines``
    makes it, and all lines of a range down to some line."""
    file, block = F.col("position.file").alias("_file"), F.col("position.block").alias("_block")
    counts = rows.groupBy(file, block).agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_file", "_block", F.coalesce(earlier, F.lit(0)).alias("_base"))  # a row for each range
    few = bases.count() <= _FEW_RANGES
    met = rows.select(held(rows, name)).join(F.broadcast(bases) if few else bases, (F.col("_held.position.file") == F.col("_file")) & (F.col("_held.position.block") == F.col("_block")))
    return met.select("_held.*", (F.col("_base") + F.col("_held.position.nth")).alias(name))


def with_runs(rows: DataFrame, counts: DataFrame, name: str = "block") -> DataFrame:
    """``rows`` of ``read_lines`` with the number of a line's run in its file, from 0. A run that goes on over the end of a range is one: a range's
    first run is the last of the range before if neither has a blank line there. counts: ``count_lines`` of the same path."""
    of_file = Window.partitionBy("file").orderBy("start")
    some = counts.where("lines > 0")  # a line that is longer than a range leaves ranges where none begins
    goes_on = F.col("opens") & F.coalesce(F.lag("closes").over(of_file), F.lit(False))
    own = some.select("file", "start", "runs", goes_on.cast("long").alias("goes_on"))
    earlier = F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(own.select("file", "start", (earlier - F.col("goes_on")).alias("_base")))  # a row for each range
    met = rows.join(F.broadcast(bases) if bases.count() <= _FEW_RANGES else bases, ["file", "start"])
    return met.withColumn(name, F.col("run") + F.col("_base")).drop("_base")
