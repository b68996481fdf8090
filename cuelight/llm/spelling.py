"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary, and the form that each is a variant of.

1. The distinct words of all documents and how often each occurs make the dictionary.
2. One edit leaves a half of the shorter word as it was: its beginning or its end. So each word is put into the forward dictionary by
   its first half and into the reversed one by its last half, as a word of its own length (for replacements) and as the
   shorter and the longer one of a pair (for insertions).
3. A block of words that share a half and are too many to compare is subdivided: what is left of them is again one edit apart, so
   again a half of it is as it was. It ends after as many steps as a length can be halved, where all that is left is the edit
   itself.
4. Both dictionaries are dealt by ranges and sorted, so blocks are runs of rows. A task scans them and compares the words of
   a block. A pair is met in one block only: the one that shares all before and after its last possible edit. What comes out is a
   row for each word that has near words, never pairs.
5. Forms are followed to roots by pointer doubling: counts at least double with each step, so a chain is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.scratch import discard, written

RUN = r"[A-Za-zÀ-ÿ]+"
_BLOCK = 256  # words of a block that are compared with one another
_SLICE_ROWS, _SLICE_CHARS = 65_536, 4 << 20
_FEW_BLOCKS = 200_000  # of 16 bytes
_KEY = ["kind", "size", "p", "s", "head", "tail"]


def _lower(word: Column) -> Column:
    """A-Z lower-cased; most words have none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, upper, lower))


def dictionary(docs: DataFrame, least_chars: int = 5, least_n: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): distinct words of at least ``least_chars`` code points that occur at least ``least_n`` times in ``docs`` (doc_id, text).

    Words are runs of letters. For one in ``slip``, by the CRC of id and run, a letter is left out: slips for the dictionary to find.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 0)).alias("run"))
    runs = runs.select("id", _lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.col("h") % F.char_length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.char_length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, kind, size, p, s) twice: with half of what is left of the word added to the ``p`` code points that are shared at its
    beginning, and to the ``s`` at its end. kind 0: words of ``size``, one replaced; kind 1: words of ``size`` and of one more."""
    k = F.col("size") - F.col("p") - F.col("s")
    m = F.floor((k + F.col("kind")) / 2).cast("int")
    cut = lambda p, s: F.struct(p.cast("int").alias("p"), s.cast("int").alias("s"))
    both = F.array(cut(F.col("p") + m, F.col("s")), cut(F.col("p"), F.col("s") + k - m + F.col("kind")))
    return rows.select("word", "n", "kind", "size", F.explode(both).alias("c")).select("word", "n", "kind", "size", "c.p", "c.s")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds head and tail, what a word shares with its block at its beginning and, reversed, at its end."""
    tail = F.reverse(F.substring("word", F.char_length("word") - F.col("s") + 1, F.col("s")))
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("p")), "tail": tail})


def _blocks(words: DataFrame, block: int) -> DataFrame:
    """(word, n, kind, size, p, s) of each word in each of its blocks; blocks of more than ``block`` words are subdivided."""
    chars = F.char_length("word")
    kind = lambda k, size: F.struct(F.lit(k).alias("kind"), size.cast("int").alias("size"))
    ways = F.array(kind(0, chars), kind(1, chars), kind(1, chars - 1))
    whole = words.select("word", "n", F.explode(ways).alias("w")).select("word", "n", "w.kind", "w.size", F.lit(0).alias("p"), F.lit(0).alias("s"))
    name = F.xxhash64(*_KEY)  # two blocks of one name are subdivided together at worst
    named = lambda rows: written(_keyed(rows).withColumn("block", name).drop("head", "tail"))
    open_, done = named(_halves(whole)), []
    while True:
        splittable = F.col("size") - F.col("p") - F.col("s") + F.col("kind") >= 2
        large = written(open_.where(splittable).groupBy("block").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select("block"))
        some = large.count()
        if not some:
            done.append(open_)
            break
        large = F.broadcast(large) if some <= _FEW_BLOCKS else large
        done.append(written(open_.join(large, "block", "left_anti")))
        following = named(_halves(open_.join(large, "block", "left_semi").drop("block")))
        discard(open_)
        open_ = following
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.drop("block")


def _near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their blocks: (word, n_near, best_n, best) of each word that has near words in a block."""
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    differs = np.zeros(rows.num_rows, np.int64)
    for c in _KEY:
        differs[1:] |= pc.not_equal(column[c][1:], column[c][:-1]).to_numpy(zero_copy_only=False)
    block = np.cumsum(differs)
    shape = np.stack([column[c].to_numpy() for c in ("kind", "size", "p", "s")])
    edges = [0, *(np.flatnonzero((shape[:, 1:] != shape[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        kind, size, p, s = shape[:, lo].tolist()
        a, b = _pairs(column["mid"][lo:hi], column["tail"][lo:hi], block[lo:hi], kind, size - p - s, s)
        if not len(a):
            continue
        both = np.concatenate((a, b)), np.concatenate((b, a))
        found, at = np.unique(both[0], return_inverse=True)
        own = pa.table({c: column[c][lo:hi].take(pa.array(found)) for c in ("head", "mid", "tail", "n")})
        word = pc.binary_join_element_wise(own["head"], own["mid"], pc.utf8_reverse(own["tail"]), "")
        order = pc.sort_indices(pa.table({"n": own["n"], "word": word}), [("n", "descending"), ("word", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        best = np.full(len(found), len(found))
        np.minimum.at(best, at, rank[np.searchsorted(found, both[1])])
        best = pa.array(order[best])
        columns = [word, pa.array(np.bincount(at, minlength=len(found))), own["n"].take(best), word.take(best)]
        yield from pa.table(columns, ["word", "n_near", "best_n", "best"]).combine_chunks().to_batches()


def _pairs(mid: pa.Array, tail: pa.Array, block: np.ndarray, kind: int, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words of the same block, whose ``mid`` (of k code points, or k + 1) is what they don't share by their block."""
    width = k + kind
    length = pc.utf8_length(mid).to_numpy()
    codes = np.frombuffer("".join(mid.to_pylist()).encode("utf-32-le"), np.uint32)
    chars = np.zeros((len(mid), width), np.uint32)
    chars[np.arange(width) < length[:, None]] = codes
    after = np.array([ord(t[-1]) for t in tail.to_pylist()], np.uint32) if s else None  # the first code point of the shared end
    left, right = [], []
    for j in range(1, len(mid)):
        a = np.flatnonzero(block[j:] == block[:-j])
        if not len(a):
            break
        b = a + j
        if kind == 0:
            near = (chars[a] != chars[b]).sum(1) == 1
        else:
            a, b = np.where(length[a] < length[b], a, b), np.where(length[a] < length[b], b, a)
            one = length[a] < length[b]
            a, b = a[one], b[one]
            ahead = np.logical_and.accumulate(chars[a, :k] == chars[b, :k], axis=1).sum(1)
            behind = np.logical_and.accumulate((chars[a, :k] == chars[b, 1:])[:, ::-1], axis=1).sum(1)
            near = ahead + behind >= k
            if after is not None:  # the edit can also be placed within the shared end: met elsewhere
                near &= ~((ahead == k) & (chars[b, k] == after[a]))
        left.append(a[near])
        right.append(b[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows a slice at a time, cut between blocks."""
    held: list[pa.RecordBatch] = []
    rows = chars = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        chars += batch.column("mid").nbytes
        if rows < _SLICE_ROWS and chars < _SLICE_CHARS:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(rows, bool)
        for c in _KEY:
            last &= pc.equal(table.column(c), table.column(c)[rows - 1]).to_numpy()
        cut = rows - int(last.sum())
        if cut:
            yield from _near(table.slice(0, cut))
        held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
        chars = sum(b.column("mid").nbytes for b in held)
    if held:
        yield from _near(pa.Table.from_batches(held))


def near_words(words: DataFrame, block: int = _BLOCK) -> DataFrame:
    """words: distinct ``word`` and ``n``. (word, n_near, best, best_n) of each word that has near ones: how many differ from it by exactly one
    code point put in, left out or replaced, and the one of the largest n, the first in the order of code points of several."""
    rows = _keyed(_blocks(words, block))
    mid = F.substring("word", F.col("p") + 1, F.char_length("word") - F.col("p") - F.col("s"))
    sorted_ = rows.select(*_KEY, mid.alias("mid"), "n").repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    found = sorted_.mapInArrow(_scanned, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("first")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return merged.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form), a forest. (word, root) of each, in about as many rounds as the length of the longest chain has bits."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = now.join(ahead, F.col("root") == F.col("_at"), "left")
        following = written(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        discard(now)
        now = following
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, times: int = 2, slip: int = 97, block: int = _BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the dictionary of ``docs`` (doc_id, text; other columns are not read).

    form: the near word of the largest n, the first in code-point order of several, if that n is at least ``times`` (2 or more) the word's own; else
    null. root: where forms lead from the word, the word itself if it has none. n_near: 0 without near words; form_n: n of the form.

    Null texts have no words; a null id counts as an empty one; rows that repeat an id or a text each count. Words of any length
    are compared whole. An empty table gives an empty result.
    """
    words = written(dictionary(docs, least_chars, least_n, slip))
    near = words.join(near_words(words, block), "word", "left")
    kept = F.col("best_n") >= times * F.col("n")
    made = written(
        near.select(
            "word", F.when(kept, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("best_n")).alias("form_n")
        )
    )
    discard(words)
    roots = _roots(made.where("form is not null"))
    return made.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
