from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelight.llm import _text, langid, quality, queries, toxicity
from cuelight.llm.sampling import fold, graded_sample
from tests.llm import plain

BIG = "/root/testdata/sf0.1"
ODD = ["", None, "x", "É!! a.\n\nB? ", "word " * 30_000, "\n", "日本語 テスト。", "a" * 100_000]


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return docs, spark.read.parquet(f"{BIG}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(tables):
    return toxicity.train(tables[0], tables[1].where(fold("doc_id", 5) != 0))


@pytest.fixture(scope="module")
def quality_model(tables):
    return quality.train(tables[0], tables[1].where(fold("doc_id", 5) != 0))


def test_span_hash_and_words():
    column = pa.array(["ab  cd\te", None, "", "ÉX y z"])
    (part,) = _text.slices(column)
    w = _text.words(part)
    raw = part.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)] == ["ab", "cd", "e", "ÉX y", "z"]
    assert w.doc.tolist() == [0, 0, 0, 3, 3]
    low = _text.lower_latin(part.data)
    assert low.tobytes() == plain.lowered(raw)
    got = _text.SpanHash(low)(w.start, w.end, 5)
    assert got.tolist() == [plain.span_hash(low.tobytes()[a:b], 5) for a, b in zip(w.start, w.end, strict=True)]


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (0, 10, 500, 3, 0, 0, 90)]).slice(1)
    parts = list(_text.slices(column, 100))
    assert [(p.lo, p.hi) for p in parts] == [(0, 1), (1, 2), (2, 6)]
    assert sum(len(p.data) for p in parts) == 603
    assert list(_text.slices(pa.array([], pa.string()))) == []


def test_sample_is_bounded_and_keeps_rare_grades(spark):
    labels = spark.range(5000).select("id", (F.col("id") % 100 == 0).cast("int").alias("g")).withColumnRenamed("id", "doc_id")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (7, None), (8, 1)], "doc_id long, g int"))
    sample, counts = graded_sample(labels, "g", 40)
    got = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    assert counts == {0: 4949, 1: 51} and got[1] == 40 and 20 <= got[0] <= 40


def test_toxicity_held_out(spark, tables, toxic_model):
    docs, labels = tables
    held = docs.join(labels.where(fold("doc_id", 5) == 0), "doc_id")
    got = toxicity.score(held, toxic_model, ["doc_id", "toxic"]).collect()
    assert sum((r.toxicity >= 0.5) == bool(r.toxic) for r in got) >= 0.98 * len(got)
    clean = [r for r in got if not r.toxic]
    assert sum(r.toxicity >= 0.5 for r in clean) <= 0.005 * len(clean)


def test_toxicity_is_the_plain_noisy_or(spark, data, toxic_model):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for r in toxicity.score(docs, toxic_model).collect():
        assert r.toxicity == pytest.approx(plain.toxic_score(r.text, toxic_model), rel=1e-9, abs=1e-12)


def test_offending_sentences(spark, toxic_model):
    text = "Ünd the of. You idiot scum moron!\nOf the."
    row = toxicity.score(docs_of(spark, [text]), toxic_model).first()
    assert [text[s.start : s.start + s.length] for s in row.toxic_spans] == ["You idiot scum moron!"]
    assert toxicity.keep_clean(docs_of(spark, [text, "the of"]), toxic_model).count() == 1


def test_toxicity_edges(spark, toxic_model):
    docs = docs_of(spark, ODD).withColumn("toxicity", F.lit("clash"))
    got = toxicity.score(docs, toxic_model)
    assert got.columns == ["doc_id", "text", "lang", "source", "toxicity", "toxic_spans"]
    rows = got.orderBy("doc_id").collect()
    assert len(rows) == len(ODD) and all(0 <= r.toxicity <= 1 for r in rows)
    assert rows[0].toxicity == rows[1].toxicity == rows[5].toxicity == 0
    assert toxicity.score(docs.limit(0), toxic_model).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    silent = toxicity.train(docs, none)
    assert all(r.toxicity < 1e-6 for r in toxicity.score(docs, silent).collect())
    one = toxicity.train(docs_of(spark, ["a b", "c d"]), spark.createDataFrame([(0, 1), (1, 1), (None, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs_of(spark, ["q"]), one).first().toxicity > 0.99


def test_noisy_or_learns_from_documents_alone():
    rng = np.random.default_rng(0)
    doc, of, bucket, y, s = [], [], [], [], 0
    for d in range(300):
        bad = d % 3 == 0
        y.append(int(bad))
        for k in range(5):
            doc.append(d)
            words = set(rng.integers(0, 200, 6).tolist()) | ({999} if bad and k == d % 5 else set())
            of += [s] * len(words)
            bucket += list(words)
            s += 1
    m = toxicity.fit_mil(np.array(doc), np.array(of), np.array(bucket), np.array(y), prior=1 / 3)
    weights = dict(zip(m.buckets.tolist(), m.weights.tolist(), strict=True))
    assert max(weights, key=weights.get) == 999
    z = m.bias + weights[999]
    assert z > 0 > m.bias


def test_quality_held_out(spark, tables, quality_model):
    docs, labels = tables
    held = docs.join(labels.where(fold("doc_id", 5) == 0), "doc_id")
    got = quality.score(held, quality_model, ["doc_id", "quality"]).collect()
    good, bad = ([r for r in got if r.quality == k] for k in (1, 0))
    assert sum(r.expected_grade < 0.5 for r in bad) >= 0.98 * len(bad)
    assert sum(r.expected_grade < 0.5 for r in good) <= 0.005 * len(good)


def test_quality_is_the_plain_score(spark, data, quality_model):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + ODD[:6]
    (part,) = _text.slices(pa.array(texts), 1 << 30)
    doc, bucket, value = quality.features(part)
    z = np.bincount(doc, quality_model.weights[bucket] * value, len(texts))
    assert z == pytest.approx([plain.quality_score(t, quality_model) for t in texts], rel=1e-9, abs=1e-9)


def test_quality_edges(spark, quality_model):
    docs = docs_of(spark, ODD).withColumn("expected_grade", F.lit("clash"))
    rows = quality.score(docs, quality_model).orderBy("doc_id").collect()
    assert len(rows) == len(ODD) and all(0 <= r.expected_grade <= 1 and len(r.tail_probability) == 1 for r in rows)
    assert quality.score(docs.limit(0), quality_model).collect() == []
    assert quality.keep_good(docs, quality_model).columns == docs.columns
    unlabelled = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.expected_grade for r in quality.score(docs, unlabelled).collect()} == {0.0}
    assert quality.keep_good(docs, unlabelled).count() == len(ODD)


def test_ordered_grades():
    rng = np.random.default_rng(3)
    n = 600
    x = rng.random(n)
    y = np.digitize(x, [0.3, 0.6, 0.8]) + 1
    doc, bucket = np.repeat(np.arange(n), 2), np.tile([5, 6], n)
    m = quality.fit_ordinal(doc, bucket, np.stack((x, 1 - x), 1).ravel() * 3, y)
    assert m.grades.tolist() == [1, 2, 3, 4] and (np.diff(m.thresholds) > 0).all()
    z = np.bincount(doc, m.weights[bucket] * np.stack((x, 1 - x), 1).ravel() * 3, n)
    tails = m.tails(z)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(m.expected(z), y)[0, 1] > 0.9
    assert np.abs(np.round(m.expected(z)) - y).mean() < 0.25


def likelihood(word, chance, pieces):
    """Sum over all segmentations, by trying them all."""
    if not word:
        return 1.0
    return sum(chance[pieces[word[:n]]] * likelihood(word[n:], chance, pieces) for n in range(1, len(word) + 1) if word[:n] in pieces)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.choice(list(b"abc"), n).tolist())
    pieces = sorted({letters(n) for n in (1, 2, 3) for _ in range(12)} | {b"a", b"b", b"c"} | {b"de"})
    chance = rng.dirichlet(np.ones(len(pieces)), 2).T
    model = langid.LanguageModel(["x", "y"], pieces, chance, np.array([0.5, 0.5]))
    words = [*(letters(n) for n in (1, 2, 5, 9, 3, 7)), b"dea", b"ad"]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    got = langid.word_scores(data, end - [len(w) for w in words], end, model)
    index = {p: i for i, p in enumerate(pieces)}
    for j in range(2):
        want = [likelihood(w, chance[:, j], index) for w in words]
        assert got[:, j] == pytest.approx([math.log(x) if x else langid._IMPOSSIBLE for x in want])


def test_expectation_maximisation_raises_the_likelihood():
    words, counts = [b"abab", b"ab", b"ba", b"c"], np.array([9.0, 5.0, 1.0, 2.0])
    pieces = [b"a", b"ab", b"b", b"ba", b"c"]
    index, last = {p: i for i, p in enumerate(pieces)}, -1e9
    for rounds in range(5):
        chance = langid.fit_pieces(words, counts, pieces, rounds)
        now = sum(c * math.log(likelihood(w, chance, index)) for w, c in zip(words, counts, strict=True))
        assert now >= last - 1e-6 and chance.sum() == pytest.approx(1)
        last = now


def test_language_held_out(spark, tables):
    got = queries.op6_language_unigrams(spark, BIG)
    rows = got.join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = spark.createDataFrame(
        [(1, "the cat and the dog " * 20, "en"), (2, "der hund und die katze " * 20, "de"), (3, None, "en"), (4, "le chat", None)], "doc_id long, text string, lang string"
    )
    model = langid.train(train)
    assert model.languages == ["de", "en"]
    docs = docs_of(spark, [*ODD, "12 34 !!", "the dog and", "und die"]).withColumn("lang_pred", F.lit(1))
    rows = langid.score(docs, model).orderBy("doc_id").collect()
    said = {r.text: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == len(ODD) + 3
    assert said[""] == said[None] == said["\n"] == said["12 34 !!"] == ("und", 0.0)
    assert said["the dog and"][0] == "en" and said["und die"][0] == "de"
    assert langid.score(docs.limit(0), model).collect() == []
    unlearned = langid.train(train.where("lang is null"))
    assert {r.lang_pred for r in langid.score(docs, unlearned).collect()} == {"und"}


def plain_forward(word, chance, index, longest):
    """log of the sum over all segmentations, a position at a time in logarithms."""
    ahead = [0.0]
    for at in range(1, len(word) + 1):
        terms = [ahead[at - n] + math.log(chance[index[word[at - n : at]]]) for n in range(1, min(at, longest) + 1) if word[at - n : at] in index]
        top = max(terms)
        ahead.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return ahead[-1]


@pytest.fixture(scope="module")
def public_model():
    pieces = langid.vocabulary(langid.public_path("byte_bpe_50k.tiktoken"))
    chance = np.random.default_rng(8).dirichlet(np.full(len(pieces), 0.3), 2).T + 1e-9
    return langid.LanguageModel(["x", "y"], pieces, chance / chance.sum(0), np.array([0.5, 0.5]))


@pytest.mark.parametrize("long", [langid.LONG_WORD, 30])
def test_whole_words_of_any_length(public_model, monkeypatch, long):
    """No cut: a word of 10,000 bytes, one Thai sentence without a blank, rows of marks that are pieces of 64 bytes."""
    monkeypatch.setattr(langid, "LONG_WORD", long)
    thai = "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e04\u0e23\u0e31\u0e1a\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35\u0e21\u0e32\u0e01" * 3
    words = [thai.encode(), b"internationaladministration" * 370 + b"xyzabcdefg", b"a" + b"=" * 200 + b"b", b"cloneembedreportprint", b"q", b"ab" * 30]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    got = langid.word_scores(data, end - [len(w) for w in words], end, public_model)
    index = {p: i for i, p in enumerate(public_model.pieces)}
    longest = max(map(len, public_model.pieces))
    for j in range(2):
        assert got[:, j] == pytest.approx([plain_forward(w, public_model.chance[:, j], index, longest) for w in words], rel=1e-9)


def test_long_words_are_fitted_in_parts_between_characters():
    text = "ab " + "\u65e5\u672c\u8a9e" * 40 + " " + "x" * 1000
    (part,) = _text.slices(pa.array(["", text]))
    data, start, end, doc = langid._letters(part)
    assert [data.tobytes()[a:b].decode() for a, b in zip(start, end, strict=True)] == text.split()
    a, b, word = langid._parts(data, start, end, 64)
    parts = [data.tobytes()[i:j].decode() for i, j in zip(a, b, strict=True)]
    assert ["".join(p for p, w in zip(parts, word, strict=True) if w == n) for n in range(3)] == text.split()
    assert max(b - a) <= 66 and min(b - a) > 0


def test_language_is_the_plain_score(spark, data):
    """The whole query against plain sums over all segmentations, with the same fitted model."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    index, longest = {p: i for i, p in enumerate(model.pieces)}, max(map(len, model.pieces))
    got, known = {r.doc_id: r for r in queries.op6_language_unigrams(spark, data).collect()}, {}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        (part,) = _text.slices(pa.array([r.text or ""]), 1 << 30)
        raw, start, end, _ = langid._letters(part)
        total = np.log(model.prior)
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            word = raw[a:b].tobytes()
            if word not in known:
                known[word] = np.array([plain_forward(word, model.chance[:, j], index, longest) for j in range(len(model.languages))])
            total = total + known[word]
        if not any(ch.isalpha() for ch in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
        else:
            assert got[r.doc_id].lang_pred == model.languages[total.argmax()]
            assert got[r.doc_id].score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)


def test_a_score_does_not_depend_on_the_batch(spark, public_model):
    text = "words that were met before and words that were not " * 3
    cache, alone = langid._Cache(2), pa.array([text])
    (one,) = _text.slices(alone)
    first, again = langid._totals(one, public_model, cache), langid._totals(one, public_model, cache)
    assert (first == again).all()
