from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from cuelight.llm import divergence, queries
from tests.test_queries import plain, run_sql

KINDS = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, most=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(lang, source, Counter(re.findall(divergence.TERM, text.translate(low)))) for text, lang, source in rows]
    docs = defaultdict(Counter)
    for lang, _, terms in held:
        docs[lang].update(set(terms))
    counts, of_lang = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in held:
        for t, n in terms.items():
            if docs[lang][t] >= least:
                counts[lang, source][t] += n
                of_lang[lang][t] += n
        counts[lang, source] += Counter()
    out = []
    for lang, source in sorted(counts):
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        own = counts[lang, source]
        pairs = [(-sum(f(p(own, t), p(counts[lang, other], t)) for t in kept), other) for k, other in counts if k == lang and other != source]
        terms = [(-f(p(own, t), p(of_lang[lang], t)), t) for t in kept if own[t] and p(own, t) > p(of_lang[lang], t)]
        for part, ranked in (("pair", pairs), ("term", terms)):
            ranked = sorted(ranked, key=lambda r: (r[0], r[1].encode()))
            out += [(lang, source, part, item, -v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= most]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_is_its_sql(spark, data):
    got = queries.op13_source_divergence(spark, data)
    assert plain(got.toPandas()) == plain(run_sql(data, queries.SQL["op13_source_divergence"]))


CASES = [
    (1, "One two, two THREE", "en", "a"), (1, "One two, two THREE", "en", "a"), (2, "one TWO three\x00four É é ß 日本", "en", "b"), (3, None, "en", None),
    (4, "two two one one one", "en", "b"), (5, "", None, None), (6, "one two", None, "a"), (7, "one 1one1 two", "", ""), (None, "one", None, "c"),
    (8, "zz " * 60_000 + "tail", "fr", "x"), (9, "zz tail", "fr", "y"), (10, "zz tail " * 3, "fr", "z"), (11, "alone", "de", "only"),
]


@pytest.mark.parametrize("most", [200, 1])
def test_nulls_ties_repeats_and_long_texts(spark, most):
    clash = [(*r, "shard", 5) for r in CASES]
    docs = spark.createDataFrame(clash, KINDS + ", part string, rank int").repartition(3)
    assert rows_of(divergence.audit(docs, most_terms=most)) == brute([r[1:4] for r in CASES], most=most)


def test_shards_are_merged_in_parts(monkeypatch):
    """Rows of one shard over several batches, more than a task holds."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_HELD_ROWS", 4)
    rows = [(0, "l", f"s{i % 3}", "t", 1, 1) for i in range(20)] + [(1, "l", "s0", "u", 1, 3)]
    names = ["shard", "lang", "source", "term", "n", "docs"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 2]]) for i in range(0, len(rows), 2)]
    made = divergence._by_shard(iter(batches), [divergence._KEEP.format(least=3)], divergence._KEPT, divergence._MERGE_SHARD)
    got = sorted((r["source"], r["term"], r["n"]) for b in made for r in b.to_pylist())
    assert got == [("s0", "t", 7), ("s0", "u", 1), ("s1", "t", 7), ("s2", "t", 6)]


def test_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], KINDS)).collect() == []
