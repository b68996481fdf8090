"""Quality of a text on an ordered scale: cumulative-link (proportional odds) regression.

P(grade <= k) = sigmoid(theta_k - w . x), with one weight vector ``w`` for all grades
and ordered thresholds. ``x`` is hashed text: runs of three character classes (so that
shouting, markup, tables and odd symbols show whatever the language), words that repeat
the one before, and words themselves, as the square root of their share of the text.
The model gives the expected grade and the tail probabilities P(grade >= k).

The model is fitted on the driver on at most ``most_per_grade`` labelled documents of each
grade; scoring is one pass over whole texts, a batch of byte buffers at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm import _text
from cuelight.llm.sampling import graded_sample
from cuelight.scratch import discard

BUCKETS = 1 << 12
_SHAPES, _WORDS = 2048, 1024  # then: repeated words, length bands


SLICE_ROWS = 256  # texts whose counts of all buckets are held at a time


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[128:] = ord("a")  # letters beyond ASCII; their bytes all count as such
    table[[9, 11, 12, 13]] = 32
    return table


_CLASS = _classes()


def features(texts: _text.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the non-zero features, sorted by document."""
    data, ends, n = texts.data, texts.ends, texts.count
    dense = np.zeros(n * BUCKETS, np.int64)
    docs = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    for lo in range(0, len(data) - 2, _text.SLICE_BYTES):  # a long text a part at a time
        hi = min(len(data), lo + _text.SLICE_BYTES + 2)
        shape = _CLASS[data[lo:hi]]
        inside = docs[lo : hi - 2] == docs[lo + 2 : hi]
        tri = (shape[:-2] << np.uint32(16) | shape[1:-1] << np.uint32(8) | shape[2:])[inside]
        bucket = (_text.mix(tri.astype(np.uint64)) % np.uint64(_SHAPES)).astype(np.int64)
        dense += np.bincount(docs[lo : hi - 2][inside] * np.int64(BUCKETS) + bucket, minlength=len(dense))
    words = _text.words(_text.Texts(0, n, data, ends))
    h = _text.SpanHash(_text.lower_latin(data))(words.start, words.end)
    again = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    key = np.concatenate((words.doc * BUCKETS + _SHAPES + (h % np.uint64(_WORDS)).astype(np.int64), words.doc[1:][again] * BUCKETS + _SHAPES + _WORDS))
    dense += np.bincount(key, minlength=len(dense))
    at = np.flatnonzero(dense)
    value, doc, bucket = dense[at].astype(np.float64), at // BUCKETS, at % BUCKETS
    count = np.diff(words.bounds)
    value = np.sqrt(value / np.where(bucket < _SHAPES, np.maximum(np.diff(ends), 1)[doc], np.maximum(count, 1)[doc]))
    band = _SHAPES + _WORDS + 1 + np.minimum(np.log2(count + 1).astype(np.int64), 30)
    doc, bucket = np.concatenate((doc, np.arange(n))), np.concatenate((bucket, band))
    value = np.concatenate((value, np.full(n, 0.3)))
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order], value[order]


@dataclass
class OrdinalModel:
    grades: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.., one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(z) @ np.diff(self.grades).astype(np.float64)


def fit_ordinal(
    doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 250
) -> OrdinalModel:
    """Maximum likelihood by Adam on whole gradients; classes weigh alike, so that rare grades count.

    Thresholds are kept in order by learning the first and the logs of the gaps.
    """
    grades, level = np.unique(y, return_inverse=True)
    k, n = len(grades), len(y)
    if k < 2:
        only = grades if k else np.zeros(1, np.int64)
        return OrdinalModel(only, np.zeros(BUCKETS), np.zeros(0))
    row_weight = (n / k) / np.bincount(level, minlength=k)[level] / n
    share = np.cumsum(np.full(k, 1 / k))[:-1]
    start = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(BUCKETS), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, gaps = p[:BUCKETS], np.exp(p[BUCKETS + 1 :])
        theta = p[BUCKETS] + np.concatenate(([0], np.cumsum(gaps)))
        z = np.bincount(doc, w[bucket] * value, n)
        cut = np.concatenate((np.full((n, 1), -40.0), theta[None, :] - z[:, None], np.full((n, 1), 40.0)), axis=1)
        s = 1 / (1 + np.exp(-np.clip(cut, -40, 40)))
        rows = np.arange(n)
        hi, lo = s[rows, level + 1], s[rows, level]
        chance = np.maximum(hi - lo, 1e-12)
        ghi, glo = -hi * (1 - hi) / chance * row_weight, lo * (1 - lo) / chance * row_weight
        by_cut = np.bincount(level + 1, ghi, k + 1) + np.bincount(level, glo, k + 1)
        by_theta = by_cut[1:-1]
        grad = np.concatenate(
            (
                np.bincount(bucket, value * -(ghi + glo)[doc], BUCKETS) + l2 * w,
                [by_theta.sum()],
                np.cumsum(by_theta[::-1])[::-1][1:] * gaps,
            )
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = p[BUCKETS] + np.concatenate(([0], np.cumsum(np.exp(p[BUCKETS + 1 :]))))
    return OrdinalModel(grades, p[:BUCKETS], theta)


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", most_per_grade: int = 1500) -> OrdinalModel:
    """Fits on at most ``most_per_grade`` labelled whole texts of each grade. No label at all: every text gets grade 0.

    Of rows that repeat an id the first text in byte order counts, so that the fit does not depend on the order of rows.
    """
    sample, _ = graded_sample(labels, grade, most_per_grade)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch.column("text"), rows=SLICE_ROWS):
                doc, bucket, value = features(part)
                bounds = np.searchsorted(doc, np.arange(part.count + 1))
                cells = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("grade").slice(part.lo, part.count),
                        pa.array([bucket[c].astype("<u2").tobytes() for c in cells], pa.binary()),
                        pa.array([value[c].astype("<f4").tobytes() for c in cells], pa.binary()),
                    ],
                    ["grade", "bucket", "value"],
                )

    # The sample has a proven bound: grades times most_per_grade.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
        .mapInArrow(vectors, "grade int, bucket binary, value binary").collect()
    )
    discard(sample)
    rows.sort(key=lambda r: (r["grade"], bytes(r["bucket"]), bytes(r["value"])))
    counts = [len(r["bucket"]) // 2 for r in rows]
    return fit_ordinal(
        np.repeat(np.arange(len(rows)), counts),
        np.frombuffer(b"".join(bytes(r["bucket"]) for r in rows), "<u2").astype(np.int64),
        np.frombuffer(b"".join(bytes(r["value"]) for r in rows), "<f4").astype(np.float64),
        np.array([r["grade"] for r in rows], np.int64),
    )


def score(docs: DataFrame, model: OrdinalModel, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all if not given), with expected_grade double and tail_probability array<double>.

    tail_probability[k] is P(grade >= the k-th grade above the lowest). Columns of those names, in whatever case, are replaced.
    Every row is scored over its whole text; null counts as empty, which has a score as well.
    """
    names = [c for c in carry or docs.columns if c.lower() not in ("expected_grade", "tail_probability")]
    schema = docs.select(names).schema.add("expected_grade", "double").add("tail_probability", T.ArrayType(T.DoubleType()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch.column("text"), rows=SLICE_ROWS):
                doc, bucket, value = features(part)
                z = np.bincount(doc, model.weights[bucket] * value, part.count)
                tails = model.tails(z)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(part.count + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel())
                )
                own = batch.select(names).slice(part.lo, part.count)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(model.expected(z)), lists], schema.names)

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(scored, schema)


def keep_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose chance to be above the lowest grade is at least ``least``, as they were: only texts
    go to Python and only verdicts come back, so columns of any name and type stay untouched.

    A model of fewer than two grades keeps all rows.
    """
    if len(model.grades) < 2:
        return docs

    def verdicts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            good = np.zeros(len(column), bool)
            for part in _text.slices(column, rows=SLICE_ROWS):
                doc, bucket, value = features(part)
                tails = model.tails(np.bincount(doc, model.weights[bucket] * value, part.count))
                good[part.lo : part.hi] = tails[:, 0] >= least
            yield pa.array(good)

    return docs.where(F.arrow_udf(verdicts, "boolean")(F.col("text").cast("string")))
