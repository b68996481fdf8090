"""A language model with hidden states: a hidden Markov model over classes of words, and how often each word occurs in its class.

A text is a sequence of words and one end. A hidden state chooses a class of the next word and moves on; a word is drawn from its class by its
count in the training texts. Classes are buckets of a hash, so that what a task holds of the chain is bounded, while the counts
of words, of which the corpus has as many as it likes, stay in tables that grow with it:

    P(text) = sum over paths of states of the product of P(state | state before) P(class | state)   x   product of P(word | class)

1. Training texts become sequences of classes in the shared folder, dealt to folds by a hash of the id; their words are counted.
2. Baum-Welch: each task adds up the expected counts of its sequences, Spark adds up those of tasks, and the driver, which sees
   a number for each state and class, makes the next model. Folds take turns (incremental EM, Neal and Hinton 1998): the counts of a
   fold take the place of those that it gave before, so that the model moves on with each fold while all texts count in the end. Folds double
   in size, and the first are gone over a few times before the others come.
3. Scaled forward recursion scores whole texts exactly. Texts are cut into stretches that are worked on side by side: the
   product of a stretch's matrices carries the forward and backward messages from one to the next.
4. The counts of a text's words: frequent words are sent to every task, as many as a bound of bytes allows, the rest are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm import _text
from cuelight.scratch import discard, written

STATES, CLASSES = 8, 32_768
STRETCH = 256
_GROUP = 512  # stretches that are worked on at once
_TEXT_BYTES = 4 << 20
_FIRST_ROUNDS, _ROUNDS = 6, 2
_FOLDS = 5  # of 1, 1, 2, 4 and 8 sixteenths
_SHARED = 0.007  # of what a state emits follows the classes' shares in all texts
_HOT_BYTES = 24 << 20


@dataclass
class Chain:
    """start: of states; move: from a state (row) to one; emit: of a class (row) in a state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass
class Words:
    """The words of some texts, null ones empty. text: of each word; word: its number in ``known``, a string array of distinct ones."""

    count: int
    text: np.ndarray
    word: np.ndarray
    known: pa.Array

    def bounds(self) -> np.ndarray:
        """Where texts begin in the sequence of all words, each text followed by its end."""
        sizes = np.bincount(self.text, minlength=self.count) + 1
        return np.concatenate(([0], np.cumsum(sizes)))

    def classes(self, classes: int) -> np.ndarray:
        """The class of each word and, as the last class, of each end."""
        bounds = self.bounds()
        out = np.full(bounds[-1], classes, np.uint16 if classes < 1 << 16 else np.uint32)
        out[np.arange(len(self.text)) + self.text] = word_class(self.known, classes)[self.word]
        return out


def words(column: pa.Array) -> Words:
    low = pc.ascii_lower(pc.fill_null(column, ""))  # before the cast, which leaves a slice with offsets that this would misread
    lists = pc.ascii_split_whitespace(low.cast(pa.large_string()))
    flat, text = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return Words(len(column), text[some.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(), coded.dictionary)


def word_class(known: pa.Array, classes: int) -> np.ndarray:
    if not len(known):
        return np.zeros(0, np.int64)
    part = next(_text.slices(known, 1 << 62))
    return (_text.SpanHash(part.data)(part.ends[:-1], part.ends[1:]) % np.uint64(classes)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place, texts): runs of texts of about _TEXT_BYTES; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TEXT_BYTES, "right")))
        yield lo, column[lo:hi]
        lo = hi


class Stretches:
    """Sequences cut into stretches, in order: start and size in ``ids``, number within and of the sequence."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, chain: Chain) -> None:
        self.ids, self.chain = ids, chain
        parts = -(-np.diff(bounds) // STRETCH)
        self.sequence = np.repeat(np.arange(len(parts)), parts)
        self.first = np.cumsum(parts) - parts  # stretch of each sequence
        self.parts = parts
        self.nth = np.arange(len(self.sequence)) - self.first[self.sequence]
        self.start = bounds[:-1][self.sequence] + self.nth * STRETCH
        self.size = np.minimum(bounds[1:][self.sequence] - self.start, STRETCH)

    def groups(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretches, live): longest first; live[t]: how many have more than t words."""
        for lo in range(0, len(own), _GROUP):
            group = own[lo : lo + _GROUP]
            group = group[np.argsort(-self.size[group], kind="stable")]
            yield group, np.searchsorted(-self.size[group], -np.arange(int(self.size[group[0]])), "left")

    def products(self, own: np.ndarray) -> np.ndarray:
        """Of each stretch: from the state of its first word, foretold, to that of its last; up to a factor."""
        k, emit = len(self.chain.start), self.chain.emit
        out = np.zeros((len(self.start), k, k))
        for group, live in self.groups(own):
            at = self.start[group]
            m = np.eye(k) * emit[self.ids[at]][:, None, :]
            for t in range(1, len(live)):
                n = live[t]
                m[:n] = (m[:n].reshape(-1, k) @ self.chain.move).reshape(n, k, k) * emit[self.ids[at[:n] + t]][:, None, :]
                if t % 16 == 0:
                    m[:n] /= m[:n].sum((1, 2), keepdims=True)
            out[group] = m / m.sum((1, 2), keepdims=True)
        return out

    def messages(self, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """before: the state of the word before each stretch (of sequences' first ones nothing); after: what follows says of its last word's."""
        k, move = len(self.chain.start), self.chain.move
        before, after = np.zeros((len(self.start), k)), np.ones((len(self.start), k))
        last = self.nth == self.parts[self.sequence] - 1
        long = self.parts[self.sequence] > 1
        if not long.any():
            return before, after
        product = self.products(np.flatnonzero(long if backward else long & ~last))
        sequences = np.flatnonzero(self.parts > 1)
        sequences = sequences[np.argsort(-self.parts[sequences], kind="stable")]
        count = self.parts[sequences]
        for j in range(1, int(count[0])):
            own = self.first[sequences[: np.searchsorted(-count, -j, "left")]] + j
            foretold = before[own - 1] @ move if j > 1 else np.broadcast_to(self.chain.start, (len(own), k))
            said = np.einsum("ni,nij->nj", foretold, product[own - 1])
            before[own] = said / said.sum(1, keepdims=True)
        if backward:
            for j in range(int(count[0]) - 1, 0, -1):
                own = self.first[sequences[: np.searchsorted(-count, -j, "left")]] + j
                said = np.einsum("nij,nj->ni", product[own], after[own]) @ move.T
                after[own - 1] = said / said.sum(1, keepdims=True)
        return before, after

    def forward(self, group: np.ndarray, live: np.ndarray, before: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Logarithm of P(stretch | what was before), and scaled forward variables (word, stretch, state) if they are kept."""
        emit, move, at = self.chain.emit, self.chain.move, self.start[group]
        alphas = np.zeros((len(live), len(group), len(self.chain.start))) if keep else None
        logs = np.zeros(len(group))
        alpha = np.where((self.nth[group] == 0)[:, None], self.chain.start, before[group] @ move)
        for t, n in enumerate(live.tolist()):
            alpha = (alpha if t == 0 else alpha[:n] @ move) * emit[self.ids[at[:n] + t]]
            total = alpha.sum(1)
            alpha /= total[:, None]
            logs[:n] += np.log(total)
            if keep:
                alphas[t, :n] = alpha
        return logs, alphas

    def scores(self) -> np.ndarray:
        """log P of each sequence."""
        before, _ = self.messages(False)
        out = np.zeros(len(self.parts))
        for group, live in self.groups(np.arange(len(self.start))):
            np.add.at(out, self.sequence[group], self.forward(group, live, before, False)[0])
        return out

    def expect(self, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
        """Adds expected counts, and returns log P of all."""
        before, after = self.messages(True)
        emit, move, k = self.chain.emit, self.chain.move, len(self.chain.start)
        log = 0.0
        for group, live in self.groups(np.arange(len(self.start))):
            logs, alphas = self.forward(group, live, before, True)
            log += logs.sum()
            at = self.start[group]
            beta = np.zeros((len(group), k))
            seen = np.zeros((len(live), len(group), k))
            pairs = np.zeros((k, k))
            for t in range(len(live) - 1, -1, -1):
                n, inner = int(live[t]), int(live[t + 1]) if t + 1 < len(live) else 0
                ends = after[group[inner:n]]
                beta[inner:n] = ends / (alphas[t, inner:n] * ends).sum(1, keepdims=True)
                if inner:
                    onward = emit[self.ids[at[:inner] + t + 1]] * beta[:inner]
                    back = onward @ move.T
                    norm = (alphas[t, :inner] * back).sum(1, keepdims=True)
                    pairs += (alphas[t, :inner] / norm).T @ onward
                    beta[:inner] = back / norm
                seen[t, :n] = alphas[t, :n] * beta[:n]
            head = self.nth[group] == 0
            started += seen[0, head].sum(0)
            if not head.all():
                onward = emit[self.ids[at[~head]]] * beta[~head]
                pairs += (before[group[~head]] / ((before[group[~head]] @ move) * onward).sum(1, keepdims=True)).T @ onward
            moved += pairs * move
            inside = np.arange(len(live))[:, None] < self.size[group]
            ids = self.ids[(at + np.arange(len(live))[:, None])[inside]]
            weight = seen[inside]
            for state in range(k):
                emitted[state] += np.bincount(ids, weight[:, state], emitted.shape[1])
        return log


def first_chain(share: np.ndarray, states: int, seed: int) -> Chain:
    """States that stay, each with the classes' shares moved at random, so that they can part."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, 0.5, (len(share), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(0))


def next_chain(emitted: np.ndarray, moved: np.ndarray, started: np.ndarray, share: np.ndarray) -> Chain:
    """The model of expected counts; no state is without any class, no move without a chance."""
    own = emitted.T + share[:, None]
    own = (1 - _SHARED) * own / own.sum(0) + _SHARED * share[:, None]
    move, start = moved + 0.1, started + 0.1
    return Chain(start / start.sum(), move / move.sum(1, keepdims=True), np.ascontiguousarray(own))


@dataclass
class LanguageModel:
    """words: (word, n) of the training texts in the shared folder. tokens, types and texts: their tokens, ends included, distinct ones and
    texts. of_class: how much is counted in each class, one for each distinct word and one for those never seen added."""

    chain: Chain
    words: DataFrame
    tokens: int
    types: int
    texts: int
    of_class: np.ndarray
    logs: list[float]  # log P of each fold before it was learned from, in the order of training


def _word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word, class, n) of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for _, texts in _texts(batch.column("text")):
                found = words(texts)
                n = pa.array(np.bincount(found.word, minlength=len(found.known)), pa.int64())
                held.append(pa.table({"word": found.known, "n": n}))
                rows += len(n)
                if rows > 1_500_000:
                    held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    rows = held[0].num_rows
                if rows > 1_000_000:
                    yield from out(held)
                    held, rows = [], 0
        if rows:
            yield from out(held)

    def out(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        made = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        for lo in range(0, made.num_rows, 100_000):
            part = made.slice(lo, 100_000).combine_chunks()
            word = part["word"].combine_chunks()
            yield pa.RecordBatch.from_arrays([word.cast(pa.string()), pa.array(word_class(word, classes), pa.int32()), part["n_sum"].combine_chunks()], ["word", "class", "n"])

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, class int, n long")
    return each.groupBy("word", "class").agg(F.sum("n").alias("n"))


def _sequences(docs: DataFrame, classes: int) -> DataFrame:
    """(fold, ids) of each text: its classes as little-endian whole numbers."""
    kind = np.uint16 if classes < 1 << 16 else np.uint32

    def coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = []
            for _, texts in _texts(column):
                found = words(texts)
                ids, bounds = found.classes(classes).astype(kind), found.bounds().tolist()
                made += [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.array(made, pa.binary())

    text = F.col("text").cast("string")
    sixteenth = F.pmod(F.xxhash64("doc_id", F.length(text)), F.lit(16))
    fold = F.ceil(F.log2(sixteenth + 1)).cast("int")
    return docs.select(fold.alias("fold"), F.arrow_udf(coded, "binary")(text).alias("ids"))


def _expected(sequences: DataFrame, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over all sequences: of (state, class), of (state, next state), of first states, and log P. What comes to the driver has the
    size of the model."""
    spark = sequences.sparkSession
    classes, states = chain.emit.shape
    kind = np.dtype("<u2" if classes <= 1 << 16 else "<u4")
    sent = spark.sparkContext.broadcast(chain)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moved, started, log = np.zeros((states, classes)), np.zeros((states, states)), np.zeros(states), 0.0
        for batch in batches:
            column = batch.column("ids")
            bounds = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy()))) // kind.itemsize
            ids = np.frombuffer(b"".join(column.to_pylist()), kind)
            if len(ids):
                log += Stretches(ids, bounds, sent.value).expect(emitted, moved, started)
        rows = np.concatenate((emitted.T, moved, started[None], np.full((1, states), log / states)))
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(rows[some, i]) for i in range(states))], names)

    names = ["at", *(f"e{i}" for i in range(states))]
    made = sequences.select("ids").mapInArrow(counted, ", ".join(["at int", *(f"{c} double" for c in names[1:])]))
    found = made.groupBy("at").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    sent.unpersist()
    rows = np.zeros((classes + states + 2, states))
    rows[found["at"].to_numpy()] = np.stack([found[c].to_numpy() for c in names[1:]], axis=1)
    return rows[:classes].T, rows[classes : classes + states], rows[-2], float(rows[-1].sum())


def train(docs: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = _ROUNDS, seed: int = 0) -> LanguageModel:
    """Learns from all whole texts of ``docs`` (doc_id, text); null texts are empty ones. Without rows the model is that of no knowledge."""
    counted = written(_word_counts(docs, classes))
    rows = counted.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()  # a row for each class at most
    texts = docs.count()
    n, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    n[rows["class"].to_numpy()], types[rows["class"].to_numpy()] = rows["n"].to_numpy(), rows["types"].to_numpy()
    of_class = n + types + 1
    share = np.concatenate((of_class, [texts + 1])).astype(np.float64)
    share /= share.sum()
    chain, given, logs = first_chain(share, states, seed), {}, []
    sequences = written(_sequences(docs, classes), "fold")
    for fold in [0] * _FIRST_ROUNDS + list(range(1, _FOLDS)) + list(range(_FOLDS)) * (rounds - 1):
        *given[fold], log = _expected(sequences.where(F.col("fold") == fold), chain)
        logs.append(log)
        chain = next_chain(*(sum(v) for v in zip(*given.values(), strict=True)), share)
    discard(sequences)
    return LanguageModel(chain, counted.select("word", "n"), int(n.sum()) + texts, int(types.sum()) + (texts > 0), texts, of_class, logs)


def _frequent(counted: DataFrame, most_bytes: int) -> tuple[pa.Table, int]:
    """The words of at least some n whose bytes are within the bound, and that n: 1 if these are all."""
    size = F.octet_length("word") + 16
    level = F.floor(F.log2("n")).cast("int")
    rows = counted.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes")).collect()  # 63 at most
    least, total = 1 << 62, 0
    for row in sorted(rows, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > most_bytes:
            break
        least = 1 << row["level"]
    else:
        least = 1
    return counted.where(F.col("n") >= least).toArrow(), least


def score(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None, hot_bytes: int = _HOT_BYTES) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all if not given), with n_tokens, n_known (tokens that occur in the training texts), base_score and score.

    score: log10 P(text) of the model, over the whole text and its end. base_score: the same of words drawn one by one by their counts, one added to each
    and to one word never seen. Null texts are empty ones: one token. Repeated rows are scored alike. Columns of those names, in whatever case, are replaced.
    A text is one task's work, of about 100 bytes of memory for each of its words.
    """
    new = ("n_tokens", "n_known", "base_score", "score")
    names = [c for c in carry or docs.columns if c.lower() not in new]
    table, least = _frequent(model.words, hot_bytes)
    rest = least > 1
    spark = docs.sparkSession
    hot = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    total = float(np.log10(model.tokens + model.types + 1))
    sent = spark.sparkContext.broadcast((model.chain, np.log10(model.of_class), hot, np.log10(table["n"].to_numpy() + 1.0)))
    classes = len(model.of_class)
    cold_kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
    kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log", pa.float64()), ("chain", pa.float64()), ("cold", cold_kind)])

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain, log_class, hot, log_n = sent.value
        for column in columns:
            parts = [pa.array([], kind)]
            for _, texts in _texts(column):
                found = words(texts)
                place = pc.index_in(found.known, hot.cast(found.known.type)).fill_null(-1).to_numpy()
                known = place >= 0
                own = np.zeros(len(found.known))
                own[known] = log_n[place[known]]
                inner = own - log_class[word_class(found.known, classes)]
                add = lambda w: np.bincount(found.text, w[found.word], found.count).astype(np.float64)  # noqa: E731, B023 (whole numbers if there are no words)
                ids, bounds = found.classes(classes), found.bounds()
                logs = Stretches(ids, bounds, chain).scores() / np.log(10)
                cold = _cold(found, ~known) if rest else pa.nulls(found.count, cold_kind)
                arrays = [pa.array(np.diff(bounds)), pa.array(add(known).astype(np.int64)), pa.array(add(own - total)), pa.array(logs + add(inner)), cold]
                parts.append(pa.StructArray.from_arrays(arrays, fields=list(kind)))
            yield pa.concat_arrays(parts)

    def _cold(found: Words, wanted: np.ndarray) -> pa.Array:
        """Of each text its words that were not sent, and how often it has them."""
        mine = wanted[found.word]
        pair, times = np.unique(found.text[mine].astype(np.int64) * len(found.known) + found.word[mine], return_counts=True)
        text, word = np.divmod(pair, max(1, len(found.known)))
        listed = pa.StructArray.from_arrays([found.known.take(pa.array(word)).cast(pa.string()), pa.array(times, pa.int64())], ["word", "times"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(found.count + 1)), pa.int32()), listed)

    form = "n_tokens long, n_known long, log double, chain double, cold array<struct<word: string, times: bigint>>"
    made = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row") if names else F.lit(0).alias("row"), F.arrow_udf(scored, form)(F.col("text").cast("string")).alias("f"))
    known, more = F.lit(0).cast("long"), F.lit(0.0)
    if rest:
        placed = written(made.withColumn("id", F.monotonically_increasing_id()))
        asked = placed.select("id", F.explode("f.cold").alias("c")).select("id", "c.word", "c.times")
        met = asked.join(model.words.where(F.col("n") < least), "word").groupBy("id")
        met = met.agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
        made = placed.join(met, "id", "left")
        known, more = F.coalesce("known", known), F.coalesce("more", more)
    end = float(np.log10(model.texts + 1)) - total
    return made.select(
        *(["row.*"] if names else []),
        F.col("f.n_tokens").alias("n_tokens"),
        (F.col("f.n_known") + known + int(model.texts > 0)).alias("n_known"),
        (F.col("f.log") + more + end).alias("base_score"),
        (F.col("f.chain") + more).alias("score"),
    )
