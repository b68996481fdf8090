from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from cuelight import scratch
from cuelight.llm import quality, toxicity
from tests.llm import plain


def test_stages_are_brute_force(spark, data):
    """The rows of each stage, and what comes out, as plain code makes them with the same fitted models."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "mixing", "best_fit_packing"]
    now = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if number == 0:
            model = quality.train(now, labels)
            bar = model.thresholds[0]
            rows = [r for r in rows if plain.quality_score(r[1], model) >= bar]
        elif number == 1:
            model = toxicity.train(now, labels)
            rows = [r for r in rows if plain.toxic_score(r[1], model) < 0.5]
        elif number == 2:
            rows = [r for r, c in zip(rows, plain.simhash([r[:2] for r in rows]), strict=True) if c[0] == c[2]]
        elif number == 3:
            rows = [r for r, n in zip(rows, plain.mixture(rows), strict=True) for _ in range(n)]
        now = stage(spark, now, data)
        if number < 4:
            assert now.columns == docs.columns
            assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(r[0] for r in rows)
            assert 0 < len(rows)
    want = sorted((d, *p) for d, t, _ in rows for p in plain.token_pieces(t))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r) for r in now.select(*columns).collect()) == want
    ran = corpus_pipeline.run(spark, data)
    assert sorted(tuple(r) for r in ran.select(*columns).collect()) == want
    for _, own in ran.toPandas().sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048


def test_a_run_leaves_its_result_alone(spark, data):
    before = set(scratch._left)
    made = corpus_pipeline.run(spark, data)
    assert set(scratch._left) - before == {made._cuelight_path} and made.count() > 0


def test_an_empty_table_goes_through(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0


def test_nulls_and_repeated_rows_go_through(spark, data, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "of the and that", None, None, 3), (3, "one two three four five six", "en", "a", 1),
            (3, "one two three four five six", "en", "a", 1), (4, "one  two three\nfour five SIX", "en", "b", 1), (5, "word " * 40_000, "en", "b", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, counts = spark.createDataFrame(rows, kinds), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        counts.append(docs.count())
        if number == 2:
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 3, 5]
    assert counts[:3] == [7, 7, 4] and counts[4] >= counts[3] > 0


def test_the_last_stage_holds_the_token_ids(spark, data):
    docs = spark.createDataFrame([(1, "some words", "a"), (2, None, "a"), (3, "word " * 5000, "b")], "doc_id long, text string, source string")
    packed = corpus_pipeline.pack_sequences(spark, docs, data).collect()
    assert len(packed) > 3
    for r in packed:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
