"""Operators that return their input's columns, with every name that they use inside as a column of the input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight.llm import langid, mixing, quality, simhash, toxicity

NAMES = (
    "size key words at from row more whole times target source_size weight _size _key _source _target _copy _more _whole need before span range rows "
    "edge last taken after most level mark id fp class component_id first root node first_id "
    "toxicity toxic_spans grade expected_grade tail_probability found scored good clean _lettered lang_pred score part piece position _text _fp"
).split()
TEXTS = ["one two three four five six", "one two three four five six", "Ünd the of. You idiot scum moron! Of the.", "", None, "BUY NOW!!! $$$ click click click", "a b c d e f g"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = {n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in NAMES}
    return made.select("*", *(c.alias(n) for n, c in named.items()), F.create_map(F.lit("k"), F.col("doc_id")).alias("kinds"), F.parse_json(F.lit("1")).alias("json"))


def same(kept, docs, replaced=()):
    """Every row that is kept has its own values in its own columns."""
    assert [c for c in kept.columns if c not in replaced] == [c for c in docs.columns if c not in replaced]
    rows = kept.collect()
    for r in rows:
        assert all(r[n] == f"{n}:{r.doc_id}" for n in NAMES if n not in replaced)
        assert r.text == TEXTS[r.doc_id] and r.kinds == {"k": r.doc_id}
    return sorted(r.doc_id for r in rows)


@pytest.fixture(scope="module")
def toxic():
    return toxicity.MilModel(-3.0, np.zeros(0, np.int64), np.zeros(0))


@pytest.fixture(scope="module")
def ordinal():
    return quality.OrdinalModel(np.array([0, 1]), np.zeros(quality.BUCKETS), np.array([-1.0]))


def test_quality(docs, ordinal):
    assert same(quality.keep_good(docs, ordinal), docs) == list(range(len(TEXTS)))
    scored = quality.score(docs, ordinal)
    same(scored, docs, ("expected_grade", "tail_probability"))
    assert all(isinstance(r.expected_grade, float) for r in scored.collect())


def test_toxicity(docs, toxic):
    assert same(toxicity.keep_clean(docs, toxic), docs) == list(range(len(TEXTS)))
    scored = toxicity.score(docs, toxic)
    same(scored, docs, ("toxicity", "toxic_spans"))
    assert all(isinstance(r.toxicity, float) for r in scored.collect())


def test_language(spark, docs):
    model = langid.train(spark.createDataFrame([(1, "one two three", "en"), (2, "und der die", "de")], "doc_id long, text string, lang string"))
    scored = langid.score(docs, model)
    same(scored, docs, ("lang_pred", "score"))
    assert {r.lang_pred for r in scored.collect()} == {"en", "de", "und"}


def test_near_duplicates(docs):
    assert same(simhash.representatives(docs), docs) == [0, 2, 3, 5, 6]


def test_mixture(docs):
    plain = sorted(r.doc_id for r in mixing.mix(docs.select("doc_id", "text", "source")).collect())
    assert same(mixing.mix(docs), docs) == plain


def test_fits_do_not_depend_on_the_order(spark):
    rows = [(i % 40, f"word{i % 7} word{i} " * (1 + i % 3) + "bad" * (i % 40 < 20), i % 40 < 20) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 20), int(i < 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    models = []
    for step in (1, -1):
        docs = spark.createDataFrame([r[:2] for r in rows[::step]], "doc_id long, text string").repartition(3)
        models.append((quality.train(docs, labels), toxicity.train(docs, labels)))
    (q, t), (q2, t2) = models
    assert (q.weights == q2.weights).all() and (q.thresholds == q2.thresholds).all()
    assert t.bias == t2.bias and (t.buckets == t2.buckets).all() and (t.weights == t2.weights).all()


def test_names_that_differ_by_case_are_replaced(spark, toxic, ordinal):
    rows = spark.createDataFrame([(1, "one two", 9, 9, 9, 9, 9)], "doc_id long, text string, Toxicity int, TOXIC_SPANS int, Expected_Grade int, Tail_Probability int, LANG_PRED int")
    assert toxicity.score(rows, toxic).select("toxicity").columns == ["toxicity"]
    assert quality.score(rows, ordinal).select("expected_grade", "tail_probability").count() == 1
    model = langid.train(rows.select("doc_id", "text", F.lit("en").alias("lang")))
    assert langid.score(rows, model).select("lang_pred", "score").first().lang_pred == "en"
