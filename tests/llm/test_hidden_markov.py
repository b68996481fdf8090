from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuelight.llm import hidden_markov, queries

KINDS = "doc_id long, text string, Score string"


def tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)), None]


def chain_of(states, classes, seed=1):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((classes, states))
    return hidden_markov.Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_scores_and_counts_sum_over_all_paths(monkeypatch):
    """Stretches of two words, so that messages pass several of them."""
    monkeypatch.setattr(hidden_markov, "STRETCH", 2)
    monkeypatch.setattr(hidden_markov, "_GROUP", 2)
    chain, rng = chain_of(3, 5), np.random.default_rng(0)
    sizes = [1, 7, 2, 4, 6, 3]
    ids, bounds = rng.integers(0, 5, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
    emitted, moved, started, logs = np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3), []
    for lo, hi in itertools.pairwise(bounds):
        own, total = ids[lo:hi], 0.0
        paths = {}
        for path in itertools.product(range(3), repeat=len(own)):
            p = chain.start[path[0]] * math.prod(chain.move[a, b] for a, b in itertools.pairwise(path)) * math.prod(chain.emit[w, s] for w, s in zip(own, path, strict=True))
            paths[path] = p
            total += p
        for path, p in paths.items():
            started[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                moved[a, b] += p / total
            for w, s in zip(own, path, strict=True):
                emitted[s, w] += p / total
        logs.append(math.log(total))
    assert np.allclose(hidden_markov.Stretches(ids, bounds, chain).scores(), logs)
    got = np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3)
    assert np.isclose(hidden_markov.Stretches(ids, bounds, chain).expect(*got), sum(logs))
    assert all(np.allclose(a, b) for a, b in zip(got, (emitted, moved, started), strict=True))


def test_words():
    found = hidden_markov.words(pa.array([" A\tb\x0bÉé\x1cé ", None, "", "a  a"]))
    known = found.known.to_pylist()
    assert [known[i] for i in found.word] == ["a", "b", "Éé\x1cé", "a", "a"] and found.text.tolist() == [0, 0, 0, 3, 3]
    assert found.bounds().tolist() == [0, 4, 5, 6, 9]
    ids = found.classes(64)
    assert (ids[[3, 4, 5, 8]] == 64).all() and ids[0] == ids[6] == ids[7] < 64


@pytest.mark.parametrize(("kind", "none"), [(pa.string(), ""), (pa.string(), None), (pa.large_string(), "")])
def test_words_of_slices(kind, none):
    """A column is cut at 4 MB; what lies behind the first cut has its own words."""
    texts = [f"Text{i} of  NUMBER\t{i} É{i}" * (i % 3) if i % 5 else none for i in range(40)]
    column = pa.array(texts, kind)
    for lo, hi in [(0, 40), (0, 7), (7, 8), (9, 31), (39, 40), (5, 6), (12, 12)]:
        found = hidden_markov.words(column[lo:hi])
        known = found.known.to_pylist()
        assert [known[i] for i in found.word] == [w for t in texts[lo:hi] for w in tokens(t)[:-1]]
        assert np.diff(found.bounds()).tolist() == [len(tokens(t)) for t in texts[lo:hi]]


def plain_scores(texts, learned, model):
    """(n_tokens, n_known, base_score, score) of each text, with the model's chain and counts by plain code."""
    c = Counter(t for text in learned for t in tokens(text))
    n, v, classes = sum(c.values()), len(c), len(model.of_class)
    name = lambda w: int(hidden_markov.word_class(pa.array([w]), classes)[0])
    of_class = Counter()
    for w, k in c.items():
        if w is not None:
            of_class[name(w)] += k + 1
    out = []
    for text in texts:
        own, alpha, log = tokens(text), None, 0.0
        for w in own:
            place = classes if w is None else name(w)
            alpha = (model.chain.start if alpha is None else alpha @ model.chain.move) * model.chain.emit[place]
            log += math.log10(alpha.sum()) + (0 if w is None else math.log10((c[w] + 1) / (of_class[place] + 1)))
            alpha = alpha / alpha.sum()
        out.append((len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), log))
    return out


ROWS = [(1, "One two three one", "x"), (1, "One two three one", "x"), (2, None, None), (3, "", "y"), (None, "two two unseen", None), (4, "w " * 30_000 + "end é", "z"), (5, " \t\n", "z")]


@pytest.mark.parametrize("hot", [1 << 24, 40, 0])
def test_all_ways_to_counts_agree_with_plain_code(spark, hot):
    """All words sent to every task, some, none. A column that differs from a new one by case only."""
    docs = spark.createDataFrame(ROWS, KINDS).repartition(2)
    model = hidden_markov.train(docs.where("doc_id < 5").select("doc_id", "text"), states=2, classes=50)
    made = hidden_markov.score(docs, model, hot_bytes=hot)
    assert made.columns == ["doc_id", "text", "n_tokens", "n_known", "base_score", "score"]
    got = {(r.doc_id, r.text): tuple(r)[2:] for r in made.collect()}
    want = plain_scores([r[1] for r in ROWS], [r[1] for r in ROWS if (r[0] or 9) < 5], model)
    assert len(got) == len(set(ROWS))
    for row, values in zip(ROWS, want, strict=True):
        assert got[row[:2]] == pytest.approx(values, rel=1e-7)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    docs = spark.createDataFrame(ROWS, KINDS)
    model = hidden_markov.train(docs.limit(0).select("doc_id", "text"), states=2, classes=20)
    assert (model.tokens, model.types) == (0, 0)
    rows = hidden_markov.score(docs, model, ["doc_id"]).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and np.isfinite(r.score) for r in rows) and len(rows) == len(ROWS)
    assert hidden_markov.score(docs.limit(0), model).collect() == []


def test_training_goes_up_and_beats_single_words_on_held_out_texts(spark):
    """The query over the smallest tables, by plain code; and what more rounds do."""
    data = "/root/testdata/sf0.01"
    got = queries.op12_hidden_markov_scores(spark, data).toPandas()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(t for d, text in rows if not out[d] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    by_id = {r.doc_id: r for r in got.itertuples()}
    for d, text in rows:
        own, r = tokens(text), by_id[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    held = got[got.held_out]
    assert len(got) == len(rows) and held.score.sum() > held.base_score.sum() * 0.985
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = hidden_markov.train(docs, states=4, classes=2000, rounds=3)
    first = model.logs[: hidden_markov._FIRST_ROUNDS]
    assert all(a < b for a, b in itertools.pairwise(first))


def check_query(spark, folder, rows):
    """The columns of the query that its contract fixes, by plain code. A null id has no remainder: its row is not held out."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = queries.op12_hidden_markov_scores(spark, str(folder)).collect()
    out = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(t for d, text in rows if not out[d] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = []
    for d, text in rows:
        own = tokens(text)
        want.append((d, out[d], len(own), sum(c[w] > 0 for w in own), n, math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and np.isfinite(a[6])


def test_query_over_texts_of_more_than_a_batch_and_null_ids(spark, tmp_path):
    rows = [(i, " ".join(f"W{k * k % (997 + i)}" for k in range(1 + i * 9000))) for i in range(1, 25)]
    check_query(spark, tmp_path, [*rows, (None, "w1 without an id"), (None, None), (None, "w1 w2"), (30, None), (31, "x" * 5_000_000 + " y w3")])


def test_query_over_texts_without_words(spark, tmp_path):
    check_query(spark, tmp_path, [(i, ("", None, " \t\n")[i % 3]) for i in range(20)])
