"""Language identification by unigrams of pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary (byte-level, so any word can be
segmented). Each language has a probability for each piece, fitted by
expectation-maximisation over all segmentations of sampled words. A word's likelihood is
the sum over all its segmentations, by the forward algorithm; a text's is the product
over all its words. The prediction is the language of the highest posterior.

The forward algorithm runs over the distinct words of a batch at once: position by
position, looking spans up by hash. Words are never cut, however long; one of over
``LONG_WORD`` bytes is worked through by itself. Words seen lately are kept in a direct-mapped table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm import _text
from cuelight.llm.tokens import public_path

SHORT = 12  # bytes of a piece; longer ones are few, and tried only where their last bytes stand
LONG_WORD = 8192
_CACHE_BITS = 18
_SLICE_BYTES = 2 << 20
_IMPOSSIBLE = -1000.0  # log-likelihood of a word that has no segmentation
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalpha()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()] + list(range(128, 256))] = True


def _span_hashes(texts: list[bytes]) -> np.ndarray:
    """Hashes of whole byte strings, as ``SpanHash`` gives for spans of any buffer."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return _text.SpanHash(data)(ends[:-1], ends[1:])


class PieceTable:
    """Open-addressed table from the hash of a span to its piece; -1 where there is none."""

    def __init__(self, hashes: np.ndarray) -> None:
        bits = max(4, int(len(hashes) * 4 - 1).bit_length())
        self._mask = np.uint64((1 << bits) - 1)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._ids = np.full(1 << bits, -1, np.int32)
        self._tries = 1
        left, slot, tries = np.arange(len(hashes)), hashes & self._mask, 1
        while len(left):
            free = self._ids[slot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self._keys[slot[put]], self._ids[slot[put]] = hashes[left[put]], left[put]
            left, slot = left[~put], (slot[~put] + np.uint64(1)) & self._mask
            self._tries = max(self._tries, tries)
            tries += 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h & self._mask
        out = np.full(len(h), -1, np.int32)
        at = np.arange(len(h))
        for _ in range(self._tries):
            ids = self._ids[slot]
            hit = (self._keys[slot] == h[at]) & (ids >= 0)
            out[at[hit]] = ids[hit]
            more = ~hit & (ids >= 0)
            if not more.any():
                break
            at, slot = at[more], (slot[more] + np.uint64(1)) & self._mask
        return out


class Lookup:
    """Finds the pieces that end at a place."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.table = PieceTable(_span_hashes(pieces))
        long = [p for p in pieces if len(p) > SHORT]
        self.lengths = sorted({len(p) for p in long})
        self._tails = PieceTable(_span_hashes(sorted({p[-SHORT:] for p in long}))) if long else None

    def short(self, spans: _text.SpanHash, stop: np.ndarray, most: int) -> np.ndarray:
        """places x lengths: the piece of 1, 2, .. ``most`` bytes, SHORT at most, that ends at each place; -1 for none."""
        back = np.arange(1, min(most, SHORT) + 1)
        return self.table(spans((stop[:, None] - back).ravel(), np.repeat(stop, len(back)))).reshape(len(stop), len(back))

    def long(self, spans: _text.SpanHash, stop: np.ndarray, before: np.ndarray | int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, pieces) of longer pieces; ``before``: bytes of the word up to each place."""
        if self._tails is None:
            return
        near = np.flatnonzero(np.broadcast_to(before > SHORT, stop.shape))
        near = near[self._tails(spans(stop[near] - SHORT, stop[near])) >= 0]
        for back in self.lengths:
            near = near[np.broadcast_to(before, stop.shape)[near] >= back]
            if not len(near):
                return
            piece = self.table(spans(stop[near] - back, stop[near]))
            hit = piece >= 0
            if hit.any():
                yield back, near[hit], piece[hit]


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of ranks: each line a base64 string and a number; all single bytes are added."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    pieces |= {bytes([b]) for b in range(256)}
    return sorted({p.lower().lstrip() for p in pieces} - {b""})


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[bytes]
    chance: np.ndarray  # pieces x languages
    prior: np.ndarray
    _lookup: Lookup | None = field(default=None, repr=False)

    def lookup(self) -> Lookup:
        if self._lookup is None:
            self._lookup = Lookup(self.pieces)
        return self._lookup

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lookup": None}


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _many_words(spans: _text.SpanHash, start: np.ndarray, end: np.ndarray, model: LanguageModel) -> np.ndarray:
    """log P(word | language) of words sorted by length, longest first, a position of all of them at a time."""
    lookup, k, length = model.lookup(), len(model.languages), end - start
    out = np.full((len(start), k), _IMPOSSIBLE)
    # What the last SHORT positions sum up to, the newest first, over exp(scale); and the logs of positions before.
    window, scale, logs = np.ones((1, len(start), k)), np.zeros((len(start), k)), [np.zeros((len(start), k))]
    reach = lookup.lengths[-1] if lookup.lengths else 0
    for at in range(1, int(length[0]) + 1):
        live = int(np.searchsorted(-length, -at, "right"))
        window, scale, stop = window[:, :live], scale[:live], start[:live] + at
        piece = lookup.short(spans, stop, at)
        word, back = np.nonzero(piece >= 0)
        total = np.zeros((live, k))
        if len(word):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            total[word[first]] = np.add.reduceat(window[back, word] * model.chance[piece[word, back]], first, axis=0)
        for size, rows, found in lookup.long(spans, stop, at):
            more = logs[len(logs) - size][rows] + _log(model.chance[found])
            lift = np.maximum(more - scale[rows], 0)  # against overflow
            scale[rows] += lift
            total[rows] = total[rows] * np.exp(-lift) + np.exp(more - scale[rows])
            window[:, rows] *= np.exp(-lift)
        norm = np.where(total > 0, total, 1.0)  # no piece may end here
        scale = scale + np.log(norm)
        window = np.concatenate(((total / norm)[None], window[: SHORT - 1] / norm))
        logs = [*logs[-(reach - 1) :], np.where(total > 0, scale, -np.inf)] if reach else logs
        done = length[:live] == at
        out[:live][done] = np.where(total[done] > 0, scale[done], _IMPOSSIBLE)
    return out


def _one_word(spans: _text.SpanHash, start: int, end: int, model: LanguageModel) -> np.ndarray:
    """log P(word | language) of one word, a position at a time in logarithms."""
    lookup, k, n = model.lookup(), len(model.languages), end - start
    chance = _log(model.chance)
    reach = max([SHORT, *lookup.lengths])
    logs = np.full((min(n, LONG_WORD) + reach + 1, k), -np.inf)  # of positions lo - reach to hi
    logs[reach] = 0.0
    for lo in range(0, n, LONG_WORD):
        hi = min(n, lo + LONG_WORD)
        at = np.arange(lo + 1, hi + 1)
        piece = lookup.short(spans, start + at, n)
        piece[np.arange(1, piece.shape[1] + 1) > at[:, None]] = -1
        place, back = np.nonzero(piece >= 0)
        hits = [(place, back + 1, piece[place, back])]
        hits += [(rows, np.full(len(rows), size), found) for size, rows, found in lookup.long(spans, start + at, at)]
        place, back, found = (np.concatenate(c) for c in zip(*hits, strict=True))
        order = np.argsort(place, kind="stable")
        place, back, found = place[order], back[order], found[order]
        bounds = np.searchsorted(place, np.arange(hi - lo + 1)).tolist()
        source = reach + 1 + place - back
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), reach + 1):
            logs[i] = np.logaddexp.reduce(logs[source[a:b]] + chance[found[a:b]], axis=0) if b > a else -np.inf
        last = logs[reach + hi - lo].copy()
        logs[: reach + 1] = logs[hi - lo : hi - lo + reach + 1].copy()
    return np.where(np.isfinite(last), last, _IMPOSSIBLE)


def word_scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: LanguageModel) -> np.ndarray:
    """log P(word | language), summed over all segmentations; words x languages."""
    out = np.zeros((len(start), len(model.languages)))
    order = np.argsort(start - end, kind="stable")
    spans = _text.SpanHash(data)
    long = int(np.count_nonzero(end - start > LONG_WORD))
    for i in order[:long].tolist():
        out[i] = _one_word(spans, int(start[i]), int(end[i]), model)
    block = max(1024, 200_000 // max(4, len(model.languages)))
    for lo in range(long, len(order), block):
        own = order[lo : lo + block]
        out[own] = _many_words(spans, start[own], end[own], model)
    return out


def fit_pieces(words: list[bytes], counts: np.ndarray, pieces: list[bytes], rounds: int = 4, floor: float = 1e-7, lookup: Lookup | None = None) -> np.ndarray:
    """Piece probabilities of one language, by expectation-maximisation. counts: of each word."""
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i]))
    words, counts = [words[i] for i in order], counts[order].astype(np.float64)
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    lookup, spans, n = lookup or Lookup(pieces), _text.SpanHash(data), len(words)
    # For each position the (length, words, pieces) of pieces that end there; live[at]: words of at least ``at`` bytes.
    live = np.searchsorted(-length, -np.arange(int(length.max(initial=0)) + 1), "right").tolist()
    lattice: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
    for at in range(1, len(live)):
        stop = start[: live[at]] + at
        found = lookup.short(spans, stop, at)
        own = [(back + 1, np.flatnonzero(found[:, back] >= 0).astype(np.int32)) for back in range(found.shape[1])]
        own = [(back, rows, found[rows, back - 1]) for back, rows in own if len(rows)]
        lattice.append(own + [(back, rows.astype(np.int32), piece) for back, rows, piece in lookup.long(spans, stop, at)])
    seen = np.zeros(len(pieces))
    for own in lattice:
        for back, rows, piece in own:
            seen += np.bincount(piece, counts[rows] * back, len(pieces))
    chance = (seen + 0.01) / (seen + 0.01).sum()
    for _ in range(rounds):
        logs = np.log(chance)
        ahead = [np.zeros(n)]  # log of what leads to a position
        for at in range(1, len(live)):
            here = np.full(live[at], -np.inf)
            for back, rows, piece in lattice[at]:
                here[rows] = np.logaddexp(here[rows], ahead[at - back][rows] + logs[piece])
            ahead.append(here)
        total = np.zeros(n)
        after = [np.full(m, -np.inf) for m in live]  # log of what follows a position, 0 at a word's end
        for at in range(1, len(live)):
            done = np.flatnonzero(length[: live[at]] == at)
            total[done], after[at][done] = ahead[at][done], 0.0
        expected = np.zeros(len(pieces))
        for at in range(len(live) - 1, 0, -1):
            for back, rows, piece in lattice[at]:
                onward = logs[piece] + after[at][rows]
                share = np.exp(np.minimum(ahead[at - back][rows] + onward - total[rows], 0.0)) * counts[rows]
                expected += np.bincount(piece, share, len(pieces))
                after[at - back][rows] = np.logaddexp(after[at - back][rows], onward)
        chance = expected / max(expected.sum(), 1e-12) + floor
        chance /= chance.sum()
    return chance


def _letters(texts: _text.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and document of each word that has a letter, without marks around it."""
    data = _text.lower_latin(texts.data)
    words = _text.words(texts)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        trim = (end - start > 1) & _PUNCTUATION[data[end - 1]]
        end[trim] -= 1
        trim = (end - start > 1) & _PUNCTUATION[data[start]]
        start[trim] += 1
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    keep = letters[end] > letters[start]
    start, end, doc = start[keep], end[keep], words.doc[keep]
    return data, start, end, doc


def _parts(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of the word of the parts of words, each of about ``most`` bytes at most, cut between characters."""
    parts = -(-(end - start) // most)
    word = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = start[word] + nth * most
    for _ in range(3):
        cut[(nth > 0) & (data[cut] & 0xC0 == 0x80)] -= 1
    return cut, np.where(nth == parts[word] - 1, end[word], np.concatenate((cut[1:], [0]))), word


def train(
    docs: DataFrame,
    path: str | None = None,
    docs_per_language: int = 300,
    max_languages: int = 256,
    most_words: int = 400_000,
    rounds: int = 4,
    fitted_bytes: int = 64,
) -> LanguageModel:
    """Learns from rows of ``docs`` with a lang: whole texts of about ``docs_per_language`` for each language.

    The documents of a language are thinned by a hash of id and text with a threshold that its count gives. The
    most frequent words of each language are fitted, an equal share of ``most_words`` each: the driver's bound. Words of over
    ``fitted_bytes`` are fitted (not scored) in parts, cut between characters, so that languages written without blanks are learned too.
    Every task holds a number for each piece and language, so more than ``max_languages`` are an error, not a smaller result.
    """
    counts = docs.where("lang is not null").groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    pieces = vocabulary(path or public_path("byte_bpe_50k.tiktoken"))
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)), np.zeros(0))
    total = {r["lang"]: r["count"] for r in counts}
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / total[k]))))
    roll = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) / float(1 << 20)
    sample = docs.where("lang is not null").where(roll < F.element_at(share, F.col("lang")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for part in _text.slices(batch.column("text")):
                data, start, end, doc = _letters(part)
                start, end, word = _parts(data, start, end, fitted_bytes)
                doc = doc[word]
                raw, tally = data.tobytes(), {}
                names = lang.slice(part.lo, part.count).to_pylist()
                for a, b, d in zip(start.tolist(), end.tolist(), doc.tolist(), strict=True):
                    key = names[d], raw[a:b]
                    tally[key] = tally.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.binary()), pa.array(list(tally.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    # About docs_per_language documents a language, and of those the frequent words.
    tallied = sample.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(counted, "lang string, word binary, n long")
    common = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    ranked = tallied.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(common))
    rows = ranked.where(F.col("place") <= most_words // len(languages)).select("lang", "word", "n").toArrow()
    lookup, chance = Lookup(pieces), np.full((len(pieces), len(languages)), 1 / len(pieces))
    for i, language in enumerate(languages):  # one at a time: the lattice of all would be languages times as large
        own = rows.filter(pc.equal(rows.column("lang"), language))
        if own.num_rows:
            chance[:, i] = fit_pieces(own.column("word").to_pylist(), own.column("n").to_numpy(), pieces, rounds, lookup=lookup)
    n = np.array([total[k] for k in languages], np.float64)
    return LanguageModel(languages, pieces, chance, n / n.sum())


class _Cache:
    """The scores of words by hash; a word takes the place of the one before it in its slot."""

    def __init__(self, languages: int) -> None:
        size = 1 << max(10, _CACHE_BITS - max(0, (languages // 8).bit_length()))  # about as many bytes for any number
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.values = np.zeros((size, languages))


def score(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all if not given), with lang_pred and score, the posterior of that language.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Whole texts count. Columns of those
    two names, in whatever case, are replaced.
    """
    names = [c for c in carry or docs.columns if c.lower() not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by vocabulary times max_languages
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        k = len(model.languages)
        cache = _Cache(k)
        label = np.array([*model.languages, "und"], object)
        for column in columns:
            known = column.is_valid().to_numpy(zero_copy_only=False) & (k > 0)
            best, posterior = np.full(len(column), k), np.zeros(len(column))
            for part in _text.slices(column, _SLICE_BYTES) if k else ():
                total = _totals(part, model, cache) + np.log(np.maximum(model.prior, 1e-12))
                best[part.lo : part.hi] = total.argmax(1)
                posterior[part.lo : part.hi] = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
            said = label[np.where(known, best, k)].tolist()
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(np.where(known, posterior, 0.0))], fields=list(kind))

    text = F.col("text").cast("string")
    found = F.arrow_udf(scored, "lang_pred string, score double")(F.when(text.rlike(r"\p{L}"), text))
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    made = docs.select(row.alias("row"), found.alias("found")) if names else docs.select(found.alias("found"))
    return made.select(*(["row.*"] if names else []), "found.lang_pred", "found.score")


def _totals(part: _text.Texts, model: LanguageModel, cache: _Cache) -> np.ndarray:
    """log P(all words | language); texts x languages."""
    data, start, end, doc = _letters(part)
    total = np.zeros((part.count, len(model.languages)))
    if len(start):
        key, first, which = np.unique(_text.SpanHash(data)(start, end), return_index=True, return_inverse=True)
        slot = (key & cache.mask).astype(np.int64)
        values = cache.values[slot]
        new = np.flatnonzero(cache.keys[slot] != key)
        if len(new):
            values[new] = word_scores(data, start[first[new]], end[first[new]], model)
            cache.keys[slot[new]], cache.values[slot[new]] = key[new], values[new]
        for j in range(len(model.languages)):
            total[:, j] = np.bincount(doc, values[which, j], part.count)
    return total
