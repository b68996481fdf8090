from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import queries, spelling
from tests.test_queries import plain, run_sql


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_is_its_sql(spark, data):
    got = queries.op11_spelling_variants(spark, data)
    assert plain(got.toPandas()) == plain(run_sql(data, queries.SQL["op11_spelling_variants"]))


@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=60, unique=True))
@settings(max_examples=5, deadline=None)
def test_subdivided_blocks_find_each_pair_once(spark, words):
    """Few letters, so that blocks are large and an edit has many places."""
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    for block in (2, 256):
        got = {r.word: (r.n_near, r.best) for r in spelling.near_words(df, block).collect()}
        n = {w: i for i, w in enumerate(words)}
        near = {w: [v for v in words if one_edit(w, v)] for w in words}
        assert got == {w: (len(v), max(v, key=n.get)) for w, v in near.items() if v}


@pytest.mark.parametrize("block", [256, 3])
def test_nulls_ties_repeats_chains_and_long_words(spark, block):
    long = "ab" * 40_000
    rows = [
        (1, "Spelling spelling SPELLING spellin spellin spellin speling speling speling"), (1, "spelling " * 20), (2, None), (None, "spelling spelling " * 3),
        (3, ""), (4, f"{long} " * 9), (5, f"{long}a {long}a {long}a"), (6, "façade façade façade façades façades Éa÷ÿß Éa÷ÿß éa÷ÿß"), (7, "ties1 tiesa tiesb " * 3),
        (8, "chain " * 3 + "chains " * 7 + "chainse " * 15 + "chainsed " * 40), (9, "short abcd abcd abcd 日本語 12345"), (10, "a" * 5000 + " "),
    ]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = rows_of(spelling.variants(docs, block=block))
    want = brute(words_of(rows))
    assert got == want and any(r[1] and r[1] != r[2] for r in want)


def test_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scanned_slices(monkeypatch):
    """Blocks that come in several batches, cut between blocks."""
    import pyarrow as pa

    monkeypatch.setattr(spelling, "_SLICE_ROWS", 3)
    rows = [(0, 5, 2, 0, head, "", mid, n) for head, mids in (("ab", "cde cdf cdg xyz"), ("ac", "cde")) for n, mid in enumerate(mids.split(), 1)]
    names = ["kind", "size", "p", "s", "head", "tail", "mid", "n"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))]) for r in rows]
    got = sorted(tuple(r.values()) for b in spelling._scanned(iter(batches)) for r in b.to_pylist())
    assert got == [("abcde", 2, 3, "abcdg"), ("abcdf", 2, 3, "abcdg"), ("abcdg", 2, 2, "abcdf")]
