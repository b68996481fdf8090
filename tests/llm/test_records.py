"""Chats, URL lists, packing, mixing and top-k."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelight.llm import chat, mixing, packing, queries, topk, url_filter
from cuelight.llm.tokens import Encoder, public_path
from tests.llm import plain
from tests.test_queries import plain as table
from tests.test_queries import run_sql


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, data, name):
    assert table(queries.QUERIES[name](spark, data).toPandas()) == table(run_sql(data, queries.SQL[name]))


LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def messages(spark, *events):
    rows = chat.fold(spark.createDataFrame(list(events), LOG)).orderBy("conv_id", "turn", "number").collect()
    return [(r.conv_id, r.turn, r.role, r.text) for r in rows]


def test_deltas_edits_and_regenerations(spark):
    got = messages(
        spark,
        (1, 0, 0, "message", "user", "helo"), (1, 4, 0, "edit", None, "hello"), (1, 1, 1, "message", "assistant", "a"), (1, 2, 1, "delta", None, "b"),
        (1, 3, 1, "delta", None, None), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "x"), (1, 7, 1, "delta", None, "y"),
        (2, 0, 0, "delta", "user", "only "), (2, 1, 0, "delta", "user", "deltas"), (2, 2, 1, "message", "assistant", "old"), (2, 3, 2, "message", "user", "void"),
        (2, 4, 1, "regenerate", None, "new"), (2, 5, 2, "message", "user", "after"),
    )
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "xy"), (2, 0, "user", "only deltas"), (2, 1, "assistant", "new"), (2, 2, "user", "after")]


def test_fold_edges(spark):
    got = messages(
        spark, (None, None, None, None, None, None), (3, 1, 1, "message", "b", "same"), (3, 1, 1, "message", "a", "turn"), (3, 1, 1, "message", "a", "turn"), (3, 2, 1, "delta", None, "+")
    )
    assert got == [(None, None, "", ""), (3, 1, "a", "turn"), (3, 1, "a", "turn"), (3, 1, "b", "same+")]
    assert chat.format_chats(spark.createDataFrame([], LOG)).collect() == []


TRICKY = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\b", "\\i", "<", "/s>", "[", "]", "INST]", "é", "😀", "\n", "a", ""]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]"]) | TRICKY, TRICKY), min_size=1, max_size=12))
def test_reading_back_is_exact(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    stored = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.messages_as_events(stored))
    row = made.select("formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")).first()
    assert [(t.role, t.text) for t in row.turns] == turns
    said = [t for r, t in turns if r == "assistant"]
    assert row.loss == "".join(said)
    spans = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
    assert [re.sub(r"\\([bijkl])", lambda m: {"b": "\\", "i": "[INST]", "j": "[/INST]", "k": "</s>", "l": "<s>"}[m[1]], s) for s in spans] == said
    assert row.formatted.count("</s>") == row.formatted.count("[INST]") == row.formatted.count("[/INST]") == len(turns)


def test_the_added_conversation(spark, data):
    row = queries.op4_chat_events(spark, data).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, 21, hashlib.sha256(said.encode()).hexdigest())


def test_streamed_logs_fold_to_the_messages(spark):
    """Only folding gives the stored texts: deltas, edits, regenerations and voided answers, in no order; rows of one turn too."""
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], ("", "é", "one two 😀 three", None, "x" * 50)[(c * 7 + t) % 5]) for c in range(40) for t in range(6)]
    rows += [(1, 2, "user", "again"), (1, 2, "user", "again"), (3, None, "system", "no turn"), (None, 0, "user", "no id")]
    stored = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.as_streamed(stored).cache()
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] > len(rows)
    got = chat.fold(log.repartition(3, "text")).orderBy("conv_id", "turn", "number").collect()
    want = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or 0, m[2], m[3]))
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == want


def test_a_long_conversation(spark):
    stored = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.format_chats(chat.messages_as_events(stored)).select(chat.loss_text(F.col("pieces")).alias("loss")).first()
    assert row.loss == "".join(map(str, range(3000)))


def test_hosts_and_paths(spark):
    urls = {
        "http://[2001:DB8::1]/x": ("[2001:db8::1]", ["x"]), "http://[::1]:80/": ("[::1]", []), "http://9.9.0.1/a/../b": ("9.9.0.1", ["b"]),
        "https://u:p@Ex.com:8/a/./b//%2E%2e/c/..": ("ex.com", ["a"]), "http://ex.com/../../x?y/../z": ("ex.com", ["x"]), "http://[::1": ("", []), "x": ("", []),
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.h, r.p) for r in rows.select("url", url_filter.host(F.col("url")).alias("h"), url_filter.path(F.col("url")).alias("p")).collect()}
    assert got == urls


def test_addresses_have_no_ends(spark):
    lists = entries(spark, *(("l", p, "2024-01-01", "add", "block") for p in ("0.1", "1", "9.9.9.9", "[::1]", "db8::1]", "ex.com/b")))
    asked = {"http://9.9.0.1/": 0, "http://9.9.9.9/x": 1, "http://[::1]:80/": 1, "http://[2001:db8::1]/": 0, "http://v0.1/": 1, "http://ex.com/a/../b/c": 1, "http://ex.com/b/../a": 0}
    pages = spark.createDataFrame([(i, u, pd.Timestamp("2024-02-01").date()) for i, u in enumerate(asked)], "page_id long, url string, fetched_at date")
    got = {r.page_id: r.n_active for r in url_filter.judge(pages, lists).collect()}
    assert [got[i] for i in range(len(asked))] == list(asked.values())


ENTRIES = "list string, pattern string, since date, action string, verdict string"


def entries(spark, *rows):
    return spark.createDataFrame([(a, b, pd.Timestamp(c).date() if c else None, d, e) for a, b, c, d, e in rows], ENTRIES)


def test_patterns_are_taken_as_hosts_of_captures_are(spark):
    named = ["Example.COM.", "user@example.com", "example.com:8080", "http://u:p@example.com:80/a/", "example.com.:443", "[::1]:80", ":80", "/only/path", "."]
    entries = spark.createDataFrame([("l", p, 1, "add", "block") for p in named], "list string, pattern string, since int, action string, verdict string")
    assert sorted(r.pattern for r in url_filter.intervals(entries).collect()) == ["[::1]", "example.com", "example.com/a"]
    pages = spark.createDataFrame([(1, "https://example.com:99/a/b", 2), (2, "https://[::1]/x", 2), (3, "https://other.org./", 2)], "page_id long, url string, fetched_at int")
    assert {r.page_id: r.n_active for r in url_filter.judge(pages, entries).collect()} == {1: 2, 2: 1, 3: 0}


def test_intervals(spark):
    got = url_filter.intervals(
        entries(
            spark, ("l", "HTTP://Ex.com/", "2024-01-01", "add", None), ("l", "ex.com", "2024-02-01", "remove", None), ("l", "ex.com", "2024-03-01", "remove", None),
            ("l", "ex.com", "2024-03-01", "add", None), ("l", "ex.com", "2024-03-01", "add", None), ("m", "ex.com/A//b/", "2024-01-01", "add", "allow"),
            (None, "x", "2024-01-01", "add", None), ("l", None, "2024-01-01", "add", None), ("l", "x", None, "add", None), ("l", "x", "2024-01-01", "what", None),
        )
    )
    assert sorted((r["list"], r.pattern, r.verdict, str(r.valid_from), str(r.valid_to)) for r in got.collect()) == [
        ("l", "ex.com", "block", "2024-01-01", "2024-02-01"), ("l", "ex.com", "block", "2024-03-01", "None"), ("m", "ex.com/A/b", "allow", "2024-01-01", "None")
    ]


def test_judging_as_of_the_fetch(spark):
    lists = entries(
        spark, ("spam", "bad.com", "2024-01-10", "add", "block"), ("spam", "bad.com", "2024-01-20", "remove", "block"), ("ok", "bad.com/good", "2024-01-12", "add", "allow"),
        ("spam", "x.bad.com", "2024-01-12", "add", "block"), ("ok", "x.bad.com", "2024-01-12", "add", "allow"),
    )
    asked = [
        ("http://bad.com/a", "2024-01-09", False, 0), ("http://bad.com/a", "2024-01-10", True, 1), ("https://u:p@WWW.bad.com:80/a?q#f", "2024-01-19", True, 1),
        ("http://bad.com./a", "2024-01-20", False, 0), ("http://bad.com/good/x", "2024-01-11", True, 1), ("http://bad.com/good/x", "2024-01-12", False, 2),
        ("http://bad.com/goods", "2024-01-12", True, 1), ("http://notbad.com/", "2024-01-12", False, 0), ("http://x.bad.com", "2024-01-13", False, 3),
        (None, "2024-01-12", False, 0), ("", "2024-01-12", False, 0), ("no url", "2024-01-12", False, 0), ("http://bad.com", None, False, 0), ("http://bad.com/" + "a/" * 5000, "2024-01-12", True, 1),
    ]
    rows = [(i % 13, u, pd.Timestamp(t).date() if t else None, "clash") for i, (u, t, _, _) in enumerate(asked)]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched_at date, entries string")
    got = sorted((r.page_id, r.blocked, r.n_active) for r in url_filter.judge(pages, lists).collect())
    assert got == sorted((i % 13, blocked, n) for i, (_, _, blocked, n) in enumerate(asked))
    assert url_filter.judge(pages.limit(0), lists).collect() == []
    assert {r.blocked for r in url_filter.judge(pages, lists.limit(0)).collect()} == {False}


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.text("abcÉéßİıſǅʼ'’.,!? \n\t0１ǆﬁ̇̈ 　 <|startoftext|>", max_size=60))
def test_ids_are_the_tokenizers(encoder, text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder._tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_the_table(spark, data, encoder):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert np.frombuffer(encoder(r.text), "<u4").tolist() == encoder._tokenizer.encode(r.text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fullest_is_the_best_subset(counts, room):
    used = packing.fullest(sorted(counts.items(), reverse=True), room)
    assert all(n <= counts[k] for k, n in used)
    sums = {sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))}
    assert sum(k * n for k, n in used) == max(s for s in sums if s <= room)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_bins_hold_each_piece_once(counts):
    plan = packing.minimum_bin_slack(counts, 64)
    fill, given_ = {}, dict.fromkeys(counts, 0)
    for i, length in enumerate(plan.length.tolist()):
        ends = [f for k, f in zip(plan.length.tolist(), plan.first.tolist(), strict=True) if k == length and f > plan.first[i]] or [counts[length]]
        for k in range(min(ends) - int(plan.first[i])):
            at = int(plan.sequence[i]) + k // int(plan.each[i])
            fill.setdefault(at, []).append((int(plan.offset[i]) + k % int(plan.each[i]) * length, length))
            given_[length] += 1
    assert given_ == counts and len(fill) == plan.sequences
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    room: list[int] = []  # first fit, longest first
    for k, n in sorted(counts.items(), reverse=True):
        for _ in range(n):
            at = next((i for i, r in enumerate(room) if r >= k), None)
            if at is None:
                room.append(64 - k)
            else:
                room[at] -= k
    assert plan.sequences <= len(room) * 1.1 + 1


def packed(spark, docs, **how):
    return packing.pack(docs, **how).toPandas()


def check_packing(rows, got):
    want = sorted((d, *p) for d, t in rows for p in plain.token_pieces(t))
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048


def test_packing_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for tasks in (1, 7):
        got = packed(spark, docs.repartition(tasks))
        check_packing(rows, got)
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "a " * 2047), (4, "a " * 2048), (5, "a " * 5000), (1, "b"), (1, "b"), (6, " \n ")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, sequence_id int")
    got = packed(spark, docs)
    check_packing(rows, got)
    with_ids = packed(spark, docs, with_ids=True)
    assert all(len(r.ids) == r.length and (r.length < 2048) <= (r.ids[-1] == 0) for r in with_ids.itertuples())
    assert len(packed(spark, docs.limit(0))) == 0
    unnamed = packed(spark, spark.createDataFrame([(None, "x")] * 3000, "doc_id long, text string").repartition(5))
    assert unnamed.doc_id.isna().all() and len(unnamed) == 3000 and unnamed.sequence_id.nunique() == -(-unnamed.length.sum() // 2048)
    assert not unnamed.duplicated(["sequence_id", "offset"]).any()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_water_level(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    df = mixing.source_weights(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long"))
    level = mixing.water_level(df, 3)
    want = plain.targets(dict(zip(names, sizes, strict=True)))
    for r in df.collect():
        assert min(3 * r.source_size, level * r.weight) == pytest.approx(want[r.source])


def test_mixture_is_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    want = sorted(d for (d, _, _), n in zip(rows, plain.mixture(rows), strict=True) for _ in range(n))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == want


def test_mixture_edges(spark):
    long = "w " * 20_000
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, long, None), (None, "q r", "é"), (None, "s", "é"), (5, "t u v w", "a"), (6, " ", "empty")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string")
    want = sorted(((d, t, s) for (d, t, s), n in zip(rows, plain.mixture(rows), strict=True) for _ in range(n)), key=repr)
    assert sorted(((r.doc_id, r.text, r.source) for r in mixing.mix(docs).collect()), key=repr) == want
    assert mixing.mix(docs.limit(0)).collect() == []


def test_a_source_of_one_long_document_does_not_vanish(spark):
    """Taken where the source comes nearer to its target by it, and only then; rows that share an id go together."""
    rows = [(1, "w " * 1000, "a"), (2, "w " * 600, "b"), (3, "w " * 3000, "c"), (4, "w " * 2000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sizes(docs)
    got = {r.row.doc_id: (r.times, r.target) for r in mixing.repetitions(sized, mixing.plan(sized), F.col("size"), F.col("key")).collect()}
    assert {d: n for d, (n, _) in got.items()} == dict(zip((1, 2, 3, 4), plain.mixture(rows), strict=True))
    for source in "abc":
        own = [(len(t.split()), *got[d]) for d, t, s in rows if s == source]
        off = abs(sum(n * size for size, n, _ in own) - own[0][2])
        assert all(abs(sum(n * size for size, n, _ in own) + step * size - own[0][2]) >= off for size, n, _ in own for step in (1,) if n < 3)


@pytest.mark.parametrize("few", [0, 3])
def test_mixture_by_ranges_of_ranges(spark, data, monkeypatch, few):
    """The same mixture when the range at the edge is looked into by ranges of its own, down to single keys."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    monkeypatch.setattr(mixing, "_RANGE_BITS", 3 if few else 20)
    monkeypatch.setattr(mixing, "_FEW", few)
    want = sorted(d for (d, _, _), n in zip(rows, plain.mixture(rows), strict=True) for _ in range(n))
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == want


def brute_top(rows, k):
    ok = [(v, np.floor(256 * np.array(e, np.float64))) for v, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (q, x) in enumerate(ok):
        if q is not None and q % 50 == 0:
            scored = sorted((-int(x @ y), v is None, v or 0, v) for j, (v, y) in enumerate(ok) if j != i and len(y) == len(x))[:k]
            out += [(q, n, s[3], -s[0]) for n, s in enumerate(scored, 1)]
    return sorted(out, key=repr)


def top(spark, rows, k=5, kind="float"):
    df = spark.createDataFrame([(v, e, 0) for v, e in rows], f"vec_id long, embedding array<{kind}>, score int")
    return sorted((tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k).collect()), key=repr)


def test_top_k_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.standard_normal((500, 12)), np.repeat(rng.standard_normal((1, 12)), 200, 0), rng.integers(-1, 2, (300, 12)))).astype(np.float32)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    want = brute_top(rows, 5)
    assert top(spark, rows) == want
    for name, size in (("BLOCK", 64), ("_PART_ROWS", 200), ("_QUERY_ROWS", 7)):
        monkeypatch.setattr(topk, name, size)
    assert top(spark, rows) == want


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_top_k_of_the_table(spark, size):
    """The query over the whole table of embeddings against all pairs."""
    folder = f"/root/testdata/sf{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in queries.op7_threshold_top_k(spark, folder).collect()), key=repr) == brute_top(rows, 5)


def test_the_grid_grows_with_the_rows():
    """What is sent, in rows: a few times the candidates as long as 65,536 queries are one block, then once more for each block."""
    for n in (10**5, 10**6, 3 * 10**6, 10**7, 10**8):
        parts, blocks = topk.grid(n, n // 50, 64)
        assert parts * blocks <= 4 * 64 + blocks
        assert n * blocks + n // 50 * parts <= (blocks + 6) * n


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_edges(spark, kind):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (50, [0.0, 0.0]), (100, None), (150, []), (200, [nan, 1.0]), (250, [None, 1.0]), (300, [1.0, 2.0, 3.0]),
            (7, [1.0, 2.0]), (8, [-0.001, 0.5]), (None, [1.0, 2.0]), (9, [1.0, 2.0])]
    assert top(spark, rows, 5, kind) == brute_top(rows, 5)
    assert top(spark, rows, 50, kind) == brute_top(rows, 50)
    assert top(spark, [(3, [1.0])], 5, kind) == [] and top(spark, rows[4:5], 5, kind) == []


def test_top_k_of_large_components(spark):
    rows = [(i * 25, [float(2**19 + i), -float(i)]) for i in range(5)]
    assert top(spark, rows, 3, "double") == sorted(
        ((q, n, v, s) for q in (0, 50, 100) for n, (s, v) in enumerate(sorted(
            ((int((2**19 + q // 25) * (2**19 + i)) * 65536 + (q // 25 * i) * 65536, 25 * i) for i in range(5) if 25 * i != q), key=lambda x: (-x[0], x[1]))[:3], 1)), key=repr)


def test_threshold_stops_early(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal((4000, 3)) * 256)
    lists, seen = topk.SortedLists(np.arange(4000), x), []
    whole = np.lexsort
    monkeypatch.setattr(topk.np, "lexsort", lambda keys: (seen.append(len(keys[0])), whole(keys))[1])
    q = np.array([100.0, 50.0, -70.0])
    scores, ids = lists.search(q, (np.zeros(0), np.zeros(0, np.int64)), 5)
    exact = whole((np.arange(4000), -(x @ q)))[:5]
    assert ids.tolist() == exact.tolist() and sum(seen) < 1500
