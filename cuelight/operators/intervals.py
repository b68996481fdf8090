"""Segments joined with the frames that fall into their windows.

Catalyst plans a join on BETWEEN alone as a nested loop. Here time is cut into ranges that hold about as many points each, by a sketch of
the points' times. A point goes to its range, once; a window goes to each range that it crosses. A range that still holds too many points, as when
many share one time, is split by a hash of the points, and its windows go to every part. In a part, points are sorted by time, and a window's
points are a run of them.

References are as many as windows times the points in each, which grows with the square of what a time holds. ``meet`` works out all but them: how many each window has, which points
are in any, and each part's points as one small block. ``lines_in_order`` deals the windows by runs of their order, sends each run the blocks that it meets, and makes its lines one after
the other: references are neither shuffled nor stored before they are lines.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import scalars as S
from cuelight.operators.numbering import held
from cuelight.scratch import written

_BITS_SENT = 16 << 20  # bytes of bitmaps that every task may get
_MOST_RANGES, _FEW_RANGES = 1024, 32
_RANGE_POINTS, _LEAST_POINTS = 100_000, 2_000
_REFS_AT_ONCE = 500_000
_RUN_REFS, _LEAST_REFS, _LINE_REFS = 100_000_000, 200_000, 16  # of a run of lines, at most and at least; a line without references counts as so many
_STEPS = 4096  # runs begin at multiples of this share of the windows
_BYTES_HELD, _BLOCKS_OPEN = 192 << 20, 16  # of the blocks that a run of lines meets; blocks whose names are unpacked


def frame_points(frames: DataFrame) -> DataFrame:
    """Adds ``point_id`` (frame_id, or the stem of frame_path where that is null or empty)."""
    name = F.nullif(F.col("frame_id").cast("string"), F.lit(""))
    stem = S.path_stem(F.col("frame_path")) if "frame_path" in frames.columns else F.lit("")
    return frames.withColumn("point_id", F.coalesce(name, stem))


def segment_window(start: Column, end: Column, margin: float = 0.0) -> Column:
    """struct(lo, hi): a missing end is the other one, ends are put in order and moved out by the margin; null if both miss."""
    margin = max(0.0, margin)
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    # Ordering leaves NaN where it is: a comparison with it does not swap.
    swap = (b < a) & ~F.isnan(a) & ~F.isnan(b)
    lo, hi = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.when(a.isNotNull(), F.struct((lo - margin).alias("lo"), (hi + margin).alias("hi")))


def _within(point: Column) -> Column:
    lo, hi = F.col("window.lo"), F.col("window.hi")
    return (point >= lo) & (point <= hi) & ~F.isnan(lo) & ~F.isnan(hi) & ~F.isnan(point)


def time_ranges(points: DataFrame) -> tuple[list[float], int]:
    """Times at which ranges of about _RANGE_POINTS points begin, or of fewer as long as cores would be idle, ascending, the first open; and the number of points. From one pass
    over the times."""
    shares = [i / _MOST_RANGES for i in range(1, _MOST_RANGES)]
    n, times = points.agg(F.count("*"), F.percentile_approx("timestamp", shares, 4_000)).first()
    idle = min(2 * points.sparkSession.sparkContext.defaultParallelism, -(-n // _LEAST_POINTS))
    ranges = min(_MOST_RANGES, max(-(-n // _RANGE_POINTS), idle))
    chosen = {times[i * _MOST_RANGES // ranges - 1] for i in range(1, ranges)} if times else set()
    return [-math.inf, *sorted(t for t in chosen if math.isfinite(t)), math.inf], n


def _ranged(df: DataFrame, column: str, out: str, splits: list[float]) -> DataFrame:
    """Adds the number of the range that a time lies in."""
    inner = splits[1:-1]
    if len(inner) <= _FEW_RANGES:  # by comparison; a search of many takes less time than comparing with all
        return df.withColumn(out, sum(((F.col(column) >= t).cast("int") for t in inner), F.lit(0)))
    made = Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)
    return made.withColumn(out, F.col(out).cast("int"))


def _parted(windows: DataFrame, points: DataFrame) -> DataFrame:
    """Points and windows dealt by range and part; in a part points by time (a), and then the windows (a, b) that cross the range."""
    right = points.where("timestamp is not null and not isnan(timestamp)").select(F.col("timestamp").cast("double").alias("timestamp"), "_order", "point_id")
    left = windows.where("window is not null and not isnan(window.lo) and not isnan(window.hi)").select("_key", "window.lo", "window.hi")
    splits, n = time_ranges(right)
    right = _ranged(right, "timestamp", "range", splits)
    left = _ranged(_ranged(left, "lo", "first", splits), "hi", "last", splits)
    left = left.where("lo <= hi").select("_key", "lo", "hi", F.explode(F.sequence("first", "last")).alias("range"))
    hot = []
    if n > 2 * _RANGE_POINTS:
        counts = right.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > 2 * _RANGE_POINTS)
        hot = [(r["range"], -(-r["n"] // _RANGE_POINTS)) for r in counts.collect()]  # a row for each range at most
    part = F.lit(0)
    if hot:
        parts = F.broadcast(right.sparkSession.createDataFrame(hot, "range int, parts int"))
        right, left = right.join(parts, "range", "left"), left.join(parts, "range", "left")
        many = F.coalesce("parts", F.lit(1))
        right = right.withColumn("part", F.pmod(F.xxhash64("_order", "point_id"), many).cast("int"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    else:
        right, left = right.withColumn("part", part), left.withColumn("part", part)
    key, order = windows.schema["_key"].dataType.simpleString(), points.schema["_order"].dataType.simpleString()
    none = lambda kind: F.lit(None).cast(kind)
    both = right.select("range", "part", F.lit(0).alias("kind"), F.col("timestamp").alias("a"), none("double").alias("b"), none(key).alias("_key"), "_order", "point_id").unionByName(
        left.select("range", "part", F.lit(1).alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b"), "_key", none(order).alias("_order"), none("string").alias("point_id"))
    )
    return both.repartition("range", "part").sortWithinPartitions("range", "part", "kind", "a")


def window_refs(windows: DataFrame, points: DataFrame) -> DataFrame:
    """windows: _key, window (lo, hi). points: timestamp, _order, point_id. (_key, _refs) of each window that has points, ends included: an array of (_order,
    point_id) in their order."""
    key, order = windows.schema["_key"].dataType.simpleString(), points.schema["_order"].dataType.simpleString()
    found = _parted(windows, points).mapInArrow(_swept, f"_key {key}, _refs array<struct<_order: {order}, point_id: string>>")
    return found.groupBy("_key").agg(F.sort_array(F.flatten(F.collect_list("_refs"))).alias("_refs"))


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Runs of rows that are equal in some columns of integers."""
    place = np.stack([batch.column(c).to_numpy() for c in columns])
    edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(place[:, lo].tolist()), batch.slice(lo, hi - lo)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table | None, pa.RecordBatch]]:
    """Rows of parts: points by time, and then windows. For each lot of windows the part, all its points, the same object each time, and the windows."""
    now, held, points = None, [], None
    for batch in batches:
        for (*own, kind), rows in _runs(batch, "range", "part", "kind"):
            if own != now:
                now, held, points = own, [], None
            if kind == 0:
                held.append(rows)
                continue
            if held:
                points, held = pa.Table.from_batches(held).combine_chunks(), []
            yield tuple(own), points, rows


def _hits(times: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the first of its points, and their number."""
    first = np.searchsorted(times, rows.column("a").to_numpy(), "left")
    return first, np.searchsorted(times, rows.column("b").to_numpy(), "right") - first


def _at_once(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of windows of about _REFS_AT_ONCE references in all; one of more comes alone."""
    done, total = 0, np.cumsum(sizes)
    while done < len(sizes):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _REFS_AT_ONCE, "right")))
        yield done, stop
        done = stop


def _places(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of numbers, one after the other, and where each ends and begins."""
    bounds = np.concatenate(([0], np.cumsum(size)))
    return np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], size), bounds


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window with its points."""
    of, times, refs = None, None, None
    for _, points, rows in _parts(batches):
        if points is None:
            continue
        if points is not of:
            of, times = points, points["a"].to_numpy()
            refs = pa.StructArray.from_arrays([points[c].combine_chunks() for c in ("_order", "point_id")], ["_order", "point_id"])
        first, size = _hits(times, rows)
        some = np.flatnonzero(size > 0)
        for lo, hi in _at_once(size[some]):
            who = some[lo:hi]
            at, bounds = _places(first[who], size[who])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), refs.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([rows.column("_key").take(pa.array(who)), lists], ["_key", "_refs"])


_MET = pa.schema([
    ("kind", pa.int32()), ("range", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("_key", pa.int64()), ("a", pa.float64()), ("b", pa.float64()),
    ("times", pa.binary()), ("named", pa.binary()), ("point_id", pa.string()),
])
_BLOCK, _WINDOW, _NAME = 0, 1, 2


def _some_rows(kind: int, own: tuple[int, int], rows: int, **columns) -> pa.RecordBatch:
    """Rows of _MET; columns that are not given are null."""
    given = columns | {c: np.full(rows, x, np.int32) for c, x in (("kind", kind), ("range", own[0]), ("part", own[1]))}
    made = [given.get(f.name, pa.nulls(rows, f.type)) for f in _MET]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, _MET, strict=True)], schema=_MET)


def _packed(**columns) -> bytes:
    batch, out = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of each part that windows cross: its points by time, as steps from one to the next. The number of points of each window that has any, and the names of points in any window."""
    of, own, times, names, marks = None, None, None, None, None

    def met() -> Iterator[pa.RecordBatch]:
        if of is not None:
            some = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for lo in range(0, len(some), 10_000):
                yield _some_rows(_NAME, own, len(some[lo : lo + 10_000]), point_id=names.take(pa.array(some[lo : lo + 10_000])))

    for place, points, rows in _parts(batches):
        if points is None:
            continue
        if points is not of:
            yield from met()
            by = np.lexsort((points["_order"].to_numpy(), points["a"].to_numpy()))
            of, own, times, names = points, place, points["a"].to_numpy()[by], points["point_id"].combine_chunks().take(pa.array(by))
            marks = np.zeros(len(times) + 1, np.int64)
            steps = {"times": _packed(t=np.diff(times.view(np.int64), prepend=0))}
            steps["named"] = _packed(order=np.diff(points["_order"].to_numpy()[by], prepend=0), name=names)
            yield _some_rows(_BLOCK, own, 1, n=[len(times)], a=times[:1], b=times[-1:], **{c: [x] for c, x in steps.items()})
        first, size = _hits(times, rows)
        some = np.flatnonzero(size > 0)
        marks += np.bincount(first[some], minlength=len(marks)) - np.bincount(first[some] + size[some], minlength=len(marks))
        yield _some_rows(_WINDOW, own, len(some), n=size[some], _key=rows.column("_key").take(pa.array(some)))
    yield from met()


def _windows(segments: DataFrame, margin: float, key: str, *carried: str) -> DataFrame:
    # As an array of one, taken apart: ends are worked out once, where Catalyst would copy their expressions into each use.
    window = F.array(segment_window(F.col("start_time"), F.col("end_time"), margin))
    return segments.select(F.col(key).alias("_key"), *carried, F.explode(window).alias("window"))


def meet(segments: DataFrame, frames: DataFrame, margin: float = 0.0) -> DataFrame:
    """What ``meet_summary`` and ``lines_in_order`` read, written. segments: start_time, end_time and ``ordinal``, a dense long from 0. frames: as ``align`` takes them, ``ordinal`` a long."""
    said = F.to_json(F.array("point_id"), {"ignoreNullFields": "false"})
    named = F.substring(said, F.lit(2), F.length(said) - 2)
    points = frame_points(frames).select("timestamp", F.col("ordinal").alias("_order"), named.alias("point_id"))
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.binary(): "binary", pa.string(): "string"}
    found = _parted(_windows(segments, margin, "ordinal"), points).mapInArrow(_counted, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in _MET))
    return written(found, "kind")


def meet_summary(found: DataFrame, total: int, margin: float = 0.0) -> DataFrame:
    """The row of ``align_summary``, of ``total`` segments."""
    each = found.where(F.col("kind") == _WINDOW).groupBy("_key").agg(F.sum("n").alias("n"))
    refs = each.agg(F.count("*").alias("some"), F.coalesce(F.sum("n"), F.lit(0)).alias("refs"))
    names = found.where(F.col("kind") == _NAME).select("point_id").distinct().agg(F.count("*").alias("names"))
    return refs.join(names).select(  # one row and one row
        F.lit(max(0.0, margin)).alias("margin_seconds"), F.lit(total).cast("long").alias("segments_total"), F.col("some").alias("segments_with_frames"),
        (F.lit(total) - F.col("some")).cast("long").alias("segments_without_frames"), F.col("refs").alias("frame_refs_total"), F.col("names").alias("unique_frames_referenced"),
    )


def lines_in_order(found: DataFrame, segments: DataFrame, total: int, margin: float = 0.0) -> DataFrame | None:
    """``value``: a line for each segment, what ``head`` has, then the names of its frames as a JSON list, and an end of an object; partitions, and rows in them, are in the order of the
    segments. found: what ``meet`` made of these ``total`` segments. None if the points that a run of lines meets are more than a task may hold."""
    session, steps = found.sparkSession, max(1, min(total, _STEPS))
    step = lambda key: F.expr(f"cast({key} * {steps}L div {max(1, total)}L as int)")
    pieces = found.where(F.col("kind") == _WINDOW).withColumn("step", step("_key"))
    refs = np.zeros(steps)
    for row in pieces.groupBy("step").agg(F.sum("n").alias("n")).collect():  # a row for each step
        refs[row["step"]] = row["n"]
    weight = refs + total / steps * _LINE_REFS
    cores = session.sparkContext.defaultParallelism
    runs = max(1, min(2 * cores, int(weight.sum()) // _LEAST_REFS), math.ceil(weight.sum() / _RUN_REFS))
    run = np.minimum(((np.cumsum(weight) - weight / 2) * runs / max(1.0, weight.sum())).astype(int), runs - 1)
    of_step = F.broadcast(session.createDataFrame([(i, r) for i, r in enumerate(run.tolist())], "step int, run int"))
    blocks = found.where(F.col("kind") == _BLOCK)
    touched = pieces.select("step", "range", "part").distinct().join(of_step, "step").select("run", "range", "part").distinct()  # a row for each run and part at most
    held_bytes = F.sum(8 * F.col("n") + F.length("times") + F.length("named")).alias("bytes")
    most = touched.join(blocks, ["range", "part"]).groupBy("run").agg(held_bytes).agg(F.max("bytes")).first()[0]
    if (most or 0) > _BYTES_HELD:
        return None
    kept = blocks.join(F.broadcast(touched), ["range", "part"])
    none = lambda kind: F.lit(None).cast(kind)
    ends = _windows(segments, margin, "ordinal", "head").select("_key", "head", F.col("window.lo").alias("a"), F.col("window.hi").alias("b")).withColumn("step", step("_key"))
    both = kept.select("run", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("_key"), "a", "b", "times", "named", none("string").alias("head")).unionByName(
        ends.join(of_step, "step").select("run", F.lit(1).alias("kind"), "_key", "a", "b", none("binary").alias("times"), none("binary").alias("named"), "head")
    )
    dealt = both.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "kind", "_key")
    return dealt.mapInArrow(_listed, "value string")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs of lines: blocks, and then windows in order. Their lines."""
    now, blocks = None, None
    for batch in batches:
        for (run, kind), rows in _runs(batch, "run", "kind"):
            if run != now:
                now, blocks = run, _Blocks()
            if kind == 0:
                blocks.add(rows)
            else:
                yield from blocks.lines(rows)


class _Blocks:
    """The points that a run of lines meets: times, and names as they were packed but for those of a few blocks."""

    def __init__(self) -> None:
        self.times: list[np.ndarray] = []
        self.packed: list[bytes] = []
        self.open: OrderedDict[int, tuple[np.ndarray, pa.Array]] = OrderedDict()

    def add(self, rows: pa.RecordBatch) -> None:
        for times, named in zip(rows.column("times"), rows.column("named"), strict=True):
            self.times.append(np.cumsum(_unpacked(times.as_py())["t"].to_numpy()).view(np.float64))
            self.packed.append(named.as_py())

    def named(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if k not in self.open:
            made = _unpacked(self.packed[k])
            self.open[k] = np.cumsum(made["order"].to_numpy()), made["name"].combine_chunks()
            if len(self.open) > _BLOCKS_OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(k)
        return self.open[k]

    def lines(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        bad = np.isnan(a) | np.isnan(b)
        a, b = np.where(bad, np.inf, a), np.where(bad, -np.inf, b)
        total, hits = np.zeros(len(a), np.int64), []
        for k, times in enumerate(self.times):
            who = np.flatnonzero((a <= times[-1]) & (b >= times[0]))
            first = np.searchsorted(times, a[who], "left")
            size = np.searchsorted(times, b[who], "right") - first
            some = size > 0
            hits.append((k, who[some], first[some], size[some]))
            total[who[some]] += size[some]
        for lo, hi in _at_once(total):
            order, names, whose = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            for k, who, first, size in hits:
                i, j = np.searchsorted(who, (lo, hi))
                if i < j:
                    at, _ = _places(first[i:j], size[i:j])
                    orders, named = self.named(k)
                    order.append(orders[at])
                    names.append(named.take(pa.array(at)))
                    whose.append(np.repeat(who[i:j], size[i:j]))
            listed = _in_order(np.concatenate(whose), np.concatenate(order), pa.concat_arrays(names))
            bounds = np.concatenate(([0], np.cumsum(total[lo:hi])))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed), ",")
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(rows.column("head").slice(lo, hi - lo), "[", joined, "]}", "")], ["value"])


def _in_order(whose: np.ndarray, order: np.ndarray, names: pa.Array) -> pa.Array:
    """Names by window, and in a window by their order."""
    if not ((whose[1:] < whose[:-1]) | (whose[1:] == whose[:-1]) & (order[1:] < order[:-1])).any():
        return names
    low, base = int(order.min()), int(whose.min())
    span = int(order.max()) - low + 1
    fits = span * (int(whose.max()) - base + 1) < 1 << 62
    return names.take(pa.array(np.argsort((whose - base) * span + (order - low)) if fits else np.lexsort((order, whose))))


def align(segments: DataFrame, frames: DataFrame, margin: float = 0.0, ranged: bool = True, key: str = "ordinal", numbers: str | None = None) -> DataFrame:
    """Every row and column of ``segments`` with ``frame_refs``: the frames in its window, in the order of frames. ``numbers``: a column for their ordinals.

    segments: start_time, end_time and ``key``, an ordinal of its rows (ids need not be unique). frames:
    frame_id, timestamp, ``ordinal``, perhaps frame_path. Repeated frames are all kept; windows without a
    frame get an empty array. ``ranged`` False joins by comparison alone, for small tables and as a check.
    """
    windows = _windows(segments, margin, key)
    points = frame_points(frames).select("timestamp", F.col("ordinal").alias("_order"), "point_id")
    if ranged:
        listed = window_refs(windows, points)
    else:
        met = windows.where("window is not null").join(points, _within(F.col("timestamp")))
        listed = met.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_order", "point_id"))).alias("_refs"))
    rows = segments.select(held(segments, "frame_refs", *([numbers] if numbers else [])))
    none = F.array().cast(f"array<struct<_order:{frames.schema['ordinal'].dataType.simpleString()},point_id:string>>")
    made = rows.join(listed, F.col("_held")[key] == F.col("_key"), "left").select("_held", F.coalesce("_refs", none).alias("_refs"))
    return made.select("_held.*", F.col("_refs.point_id").alias("frame_refs"), *([F.col("_refs._order").alias(numbers)] if numbers else []))


def align_summary(aligned: DataFrame, margin: float = 0.0, frames: DataFrame | None = None, numbers: str = "frame_ordinals") -> DataFrame:
    """One row: how many segments have frames, and how many references and distinct frames there are.

    With ``frames`` and their ordinals in ``numbers``, as ``align`` makes them, references are never shuffled: each task sets bits of the ordinals that it meets, the
    bits are united, and the names of frames whose bit is set are counted. Else the references themselves are told apart.
    """
    aligned = written(aligned.select("frame_refs", *([numbers] if frames is not None else [])))
    some = F.size("frame_refs") > 0
    totals = aligned.agg(
        F.lit(max(0.0, margin)).alias("margin_seconds"),
        F.count("*").alias("segments_total"),
        F.count_if(some).alias("segments_with_frames"),
        F.count_if(~some).alias("segments_without_frames"),
        F.coalesce(F.sum(F.size("frame_refs")), F.lit(0)).alias("frame_refs_total"),
    )
    if frames is None:
        named = aligned.select(F.explode("frame_refs").alias("point_id"))
    else:
        named = _marked(frame_points(frames), aligned.select(F.explode(F.col(numbers).cast("array<bigint>")).alias("n")))
    distinct = named.select("point_id").distinct().agg(F.count("*").alias("unique_frames_referenced"))
    return totals.join(distinct)  # one row and one row


def _marked(points: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``points`` whose ordinal is among ``n``, by bitmaps of 32,768 ordinals."""
    bucket, bit = (lambda n: F.bitmap_bucket_number(n + 1)), (lambda n: F.bitmap_bit_position(n + 1))
    maps = met.groupBy(bucket(F.col("n")).alias("_bucket")).agg(F.bitmap_construct_agg(bit(F.col("n"))).alias("_bits"))
    maps = written(maps)
    few = maps.count() * 4096 <= _BITS_SENT
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = points.withColumns({"_bucket": bucket(F.col("ordinal").cast("long")), "_at": bit(F.col("ordinal").cast("long"))})
    joined = placed.join(F.broadcast(maps) if few else maps, "_bucket")
    return joined.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
