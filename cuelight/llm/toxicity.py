"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

p(sentence) = sigmoid(b + sum of weights of its distinct features), and a document is
toxic if any sentence is: P(document) = 1 - prod(1 - p(sentence)), the noisy-or. The
weights are trained from document labels alone; what they learn then locates the
offending sentences. Features are hashed words and their beginnings of 3 to 10 bytes,
so that an inflected form counts with its stem, in any language.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or before a new line.
Fitted on the driver on at most ``most_per_label`` labelled documents of each label.
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
from cuelight.scratch import discard, written

BUCKETS = 1 << 20
_STEMS = (3, 4, 5, 6, 7, 8, 9, 10)
LEAST_DOCS, LEAST_LIFT = 4, 2.0
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>*_-"]] = True


@dataclass
class Sentences:
    doc: np.ndarray  # of each sentence
    start: np.ndarray  # bytes in the slice
    end: np.ndarray
    of: np.ndarray  # sentence of each feature
    bucket: np.ndarray


def sentences(texts: _text.Texts) -> Sentences:
    data = _text.lower_latin(texts.data)
    words = _text.words(texts)
    n = len(words.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, none)
    last = data[words.end - 1]
    lines = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))[words.start]
    opens = np.ones(n, bool)
    opens[1:] = (words.doc[1:] != words.doc[:-1]) | np.isin(last[:-1], (33, 46, 63)) | (lines[1:] != lines[:-1])
    number = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    closing = np.concatenate((first[1:], [n])) - 1
    # A word without the marks around it.
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        trim = (end - start > 1) & _EDGE[data[end - 1]]
        end[trim] -= 1
        trim = (end - start > 1) & _EDGE[data[start]]
        start[trim] += 1
    spans = _text.SpanHash(data)
    of, keys = [number], [spans(start, end)]
    for size in _STEMS:
        longer = end - start > size
        of.append(number[longer])
        keys.append(spans(start[longer], start[longer] + size, salt=size))
    bucket = (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64)
    return Sentences(words.doc[first], words.start[first], words.end[closing], np.concatenate(of), bucket)


@dataclass
class MilModel:
    bias: float
    buckets: np.ndarray  # ascending; those of a weight other than 0
    weights: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sentence_logits(s: Sentences, table: np.ndarray, bias: float) -> np.ndarray:
    """Each distinct feature of a sentence counts once; features without weight need no such care."""
    w = table[s.bucket]
    used = np.flatnonzero(w)
    key = np.unique(s.of[used] * BUCKETS + s.bucket[used])
    return bias + np.bincount(key // BUCKETS, table[key % BUCKETS], len(s.doc))


def _noisy_or(s: Sentences, z: np.ndarray, docs: int) -> np.ndarray:
    """P(any sentence is toxic) of each document; 0 without a sentence."""
    return -np.expm1(-np.bincount(s.doc, _softplus(z), docs))


def fit_mil(
    doc: np.ndarray,
    of: np.ndarray,
    bucket: np.ndarray,
    y: np.ndarray,
    prior: float = 0.25,
    least_docs: int = LEAST_DOCS,
    least_lift: float = LEAST_LIFT,
    l1: float = 5e-5,
    rounds: int = 200,
) -> MilModel:
    """doc: of each sentence; of, bucket: sentence and feature, distinct pairs; y: 0 or 1 of each document.

    Noisy-or likelihood, by proximal Adam steps on whole gradients. Weights are evidence and never negative,
    so features that are not ``least_lift`` times as frequent among the toxic documents as among the others,
    or that fewer than ``least_docs`` documents have, are left out beforehand. ``prior``: what the
    toxic documents weigh together, whatever their share. If either label is missing, all documents get its rate.
    """
    n = len(y)
    if n == 0 or y.min() == y.max():
        return MilModel(-30.0 if n == 0 or y[0] == 0 else 30.0, np.zeros(0, np.int64), np.zeros(0))
    pair = np.unique(bucket * n + doc[of])
    found, at = np.unique(pair // n, return_inverse=True)
    count = np.bincount(at)
    toxic = np.bincount(at, y[pair % n])
    lifted = toxic / y.sum() >= least_lift * (count - toxic + 0.5) / (n - y.sum())
    frequent = found[(count >= least_docs) & lifted]
    size = len(frequent)
    at = np.searchsorted(frequent, bucket)
    known = np.zeros(len(bucket), bool)
    known[at < size] = frequent[at[at < size]] == bucket[at < size]
    of, at = of[known], at[known]
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (n - y.sum()))
    p = np.zeros(size + 1)
    p[-1] = -6.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    rate = 0.15
    for step in range(1, rounds + 1):
        z = p[-1] + np.bincount(of, p[:-1][at], len(doc))
        none = np.bincount(doc, _softplus(z), n)  # -log P(no sentence is toxic)
        push = np.where(y == 1, -1 / np.expm1(np.clip(none, 1e-9, 500)), 1.0) * weight
        slope = push[doc] / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.concatenate((np.bincount(at, slope[of], size), [slope.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-7
        p = p - rate * (m / (1 - 0.9**step)) / scale
        p[:-1] = np.maximum(p[:-1] - rate * l1 / scale[:-1], 0)
    used = np.flatnonzero(p[:-1] > 1e-6)
    return MilModel(float(p[-1]), frequent[used], p[used])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_per_label: int = 2500) -> MilModel:
    """Fits on whole texts of at most ``most_per_label`` documents of each label. ``labels``: those to learn from.

    Of rows that repeat an id the first text in byte order counts, so that the fit does not depend on the order of rows.
    """
    sample, _ = graded_sample(labels.where(F.col(label).isin(0, 1)), label, most_per_label)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch.column("text")):
                s = sentences(part)
                key = np.unique(s.of * BUCKETS + s.bucket)
                of, bucket = key // BUCKETS, key % BUCKETS
                first = np.searchsorted(s.doc, np.arange(part.count + 1))
                cut = pa.array(np.searchsorted(of, first).astype(np.int32))
                own = of - first[s.doc[of]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("grade").slice(part.lo, part.count),
                        pa.array((first[1:] - first[:-1]).astype(np.int32)),
                        pa.ListArray.from_arrays(cut, pa.array(own.astype(np.int32))),
                        pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32))),
                    ],
                    ["grade", "sentences", "of", "bucket"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample has a proven bound: two labels times most_per_label.
    table = written(
        texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
        .mapInArrow(bags, "grade int, sentences int, of array<int>, bucket array<int>")
    )
    n, toxic = table.agg(F.count("*"), F.coalesce(F.sum("grade"), F.lit(0))).first()
    # What could be evidence is found where the sample lies; only that comes to the driver.
    seen = table.select("grade", F.explode(F.array_distinct("bucket")).alias("bucket")).groupBy("bucket")
    seen = seen.agg(F.count("*").alias("n"), F.sum("grade").alias("toxic"))
    lifted = F.col("toxic") * (n - toxic) >= LEAST_LIFT * toxic * (F.col("n") - F.col("toxic") + 0.5)
    kept = np.sort(np.array([r[0] for r in seen.where((F.col("n") >= LEAST_DOCS) & lifted).select("bucket").collect()], np.int64))

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("of", "bucket")]
            of, bucket = (c.flatten().to_numpy() for c in columns)
            ends = np.concatenate(([0], np.cumsum(columns[0].value_lengths().to_numpy(zero_copy_only=False))))
            keep = np.isin(bucket, kept)
            cut = np.concatenate(([0], np.cumsum(keep)))[ends]
            of, bucket = of[keep].astype("<u4"), bucket[keep].astype("<u4")
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (of, bucket)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("sentences"), *packed], ["grade", "sentences", "of", "bucket"])

    rows = table.mapInArrow(screened, "grade int, sentences int, of binary, bucket binary").collect()
    discard(table, sample)
    rows.sort(key=lambda r: (r["grade"], r["sentences"], bytes(r["bucket"]), bytes(r["of"])))
    bag = np.array([r["sentences"] for r in rows], np.int64)
    base = np.concatenate(([0], np.cumsum(bag)))
    counts = [len(r["of"]) // 4 for r in rows]
    of = np.frombuffer(b"".join(bytes(r["of"]) for r in rows), "<u4").astype(np.int64) + np.repeat(base[:-1], counts)
    bucket = np.frombuffer(b"".join(bytes(r["bucket"]) for r in rows), "<u4").astype(np.int64)
    y = np.array([r["grade"] for r in rows], np.int64)
    return fit_mil(np.repeat(np.arange(len(rows)), bag), of, bucket, y)


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("length", "integer").add("probability", "double"))


def score(docs: DataFrame, model: MilModel, carry: list[str] | None = None, offending: float = 0.5) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all if not given), with toxicity double and toxic_spans; columns of
    those names, in whatever case, are replaced.

    toxicity: noisy-or over all sentences of the whole text; empty and null texts have no sentence, so 0.
    toxic_spans: start and length in characters, and probability, of sentences of at least ``offending``.
    """
    names = [c for c in carry or docs.columns if c.lower() not in ("toxicity", "toxic_spans")]
    schema = docs.select(names).schema.add("toxicity", "double")
    schema = schema.add("toxic_spans", SPANS)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by BUCKETS

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = model.table()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            for part in _text.slices(batch.column("text")):
                s = sentences(part)
                z = _sentence_logits(s, table, model.bias)
                chance = _noisy_or(s, z, part.count)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                spans: list[list[dict]] = [[] for _ in range(part.count)]
                hot = np.flatnonzero(p >= offending)
                if len(hot):
                    chars = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
                    begin = chars[s.start[hot]] - chars[part.ends[s.doc[hot]]]
                    length = chars[s.end[hot]] - chars[s.start[hot]]
                    for d, a, c, q in zip(s.doc[hot].tolist(), begin.tolist(), length.tolist(), p[hot].tolist(), strict=True):
                        spans[d].append({"start": a, "length": c, "probability": q})
                own = batch.select(names).slice(part.lo, part.count)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(chance), pa.array(spans, kind)], schema.names)

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(scored, schema)


def keep_clean(docs: DataFrame, model: MilModel, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` of a toxicity under ``most``, as they were: only texts go to Python and only verdicts come
    back, so columns of any name and type stay untouched."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS

    def verdicts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value.table()
        for column in columns:
            clean = np.zeros(len(column), bool)
            for part in _text.slices(column):
                s = sentences(part)
                clean[part.lo : part.hi] = _noisy_or(s, _sentence_logits(s, table, sent.value.bias), part.count) < most
            yield pa.array(clean)

    return docs.where(F.arrow_udf(verdicts, "boolean")(F.col("text").cast("string")))
