"""Plain versions of the operators, a row and a pair at a time, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

from cuelight.llm import quality, toxicity
from cuelight.llm.tokens import public_path

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def span_hash(data, salt=0):
    total, power = 0, 1
    for b in data:
        total = (total + (b + 1) * power) & MASK
        power = power * BASE & MASK
    return mixed((total + salt) & MASK)


def lowered(data):
    out = re.sub(rb"[A-Z]", lambda m: m[0].lower(), data)
    return re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), out)


def split(data):
    return [w for w in BLANKS.split(data) if w]


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def fingerprint(text, shingle=4):
    tokens = split(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + shingle]) for i in range(max(1, len(tokens) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash(rows):
    """rows: (doc_id, text). (doc_id, fingerprint, component) of each, by position."""
    prints = [fingerprint(t) for _, t in rows]
    groups = Groups()
    for i, a in enumerate(prints):
        groups.find(i)
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                groups.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[groups.find(i)] = min(doc, least.get(groups.find(i), doc))
    return [(doc, f"{p:016x}", least.get(groups.find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))]


def targets(sizes, epochs=3):
    """sizes: source to words. Clamps and shares again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if epochs * sizes[s] <= level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        free -= over
    return out


def mixture(rows, seed=0):
    """rows: (doc_id, text, source). Times that each is taken, by position."""
    size = [len(split((t or "").encode())) for _, t, _ in rows]
    key = [int(hashlib.md5(f"{seed}:{d if d is not None else (t or '')}".encode()).hexdigest()[:15], 16) for d, t, _ in rows]
    total = {}
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] = total.get(s, 0) + n
    target, times = targets(total), [0] * len(rows)
    for source, words in total.items():
        own = sorted((i for i in range(len(rows)) if rows[i][2] == source), key=lambda i: key[i])
        whole = min(3, math.floor(target[source] / words)) if words else 0
        for i in own:
            times[i] = whole
        rest, after, most = target[source] - whole * words, -1, math.inf
        more = dict.fromkeys(own, 0)
        for _ in range(3):
            if rest <= 0:
                break
            used, edge = 0, after
            open_ = [i for i in own if key[i] > after and size[i] <= most]
            for k in sorted({key[i] for i in open_}):
                peers = [i for i in open_ if key[i] == k]
                words_ = sum(size[i] for i in peers)
                if used + words_ > rest:
                    break
                used += words_
                edge = k
                for i in peers:
                    more[i] = 1
            rest, after, most = rest - used, edge, rest - used
        left = [i for i in own if not more[i]]
        if rest > 0 and left:
            best = min(left, key=lambda i: (abs(size[i] - rest), key[i]))
            peers = [i for i in left if key[i] == key[best]]
            if abs(sum(size[i] for i in peers) - rest) < rest:
                more |= dict.fromkeys(peers, 1)
        for i in own:
            times[i] += more[i]
    return times


_tokenizer = None


def token_pieces(text, capacity=2048):
    global _tokenizer
    _tokenizer = _tokenizer or Tokenizer.from_file(public_path("word_bpe_49k.json"))
    ids = np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(k, k * capacity, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // capacity)) for p in [ids[k * capacity : (k + 1) * capacity]]]


def quality_score(text, model):
    data = (text or "").encode()
    kind = lambda b: 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (9, 11, 12, 13) else b
    shape, counts = [kind(b) for b in data], {}
    for i in range(len(data) - 2):
        at = mixed(shape[i] << 16 | shape[i + 1] << 8 | shape[i + 2]) % quality._SHAPES
        counts[at] = counts.get(at, 0) + 1
    hashes = [span_hash(w) for w in split(lowered(data))]
    for i, h in enumerate(hashes):
        at = quality._SHAPES + h % quality._WORDS
        counts[at] = counts.get(at, 0) + 1
        if i and hashes[i - 1] == h:
            again = quality._SHAPES + quality._WORDS
            counts[again] = counts.get(again, 0) + 1
    z = sum(model.weights[k] * math.sqrt(n / (max(len(data), 1) if k < quality._SHAPES else max(len(hashes), 1))) for k, n in counts.items())
    return z + 0.3 * model.weights[quality._SHAPES + quality._WORDS + 1 + min(int(math.log2(len(hashes) + 1)), 30)]


def toxic_score(text, model):
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    data = lowered((text or "").encode())
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    sentences, now = [], []
    for i, (a, b) in enumerate(words):
        now.append(data[a:b])
        if data[b - 1 : b] in (b".", b"!", b"?") or i + 1 == len(words) or b"\n" in data[b : words[i + 1][0]]:
            sentences.append(now)
            now = []
    none = 0.0
    for sentence in sentences:
        found = set()
        for word in sentence:
            for _ in range(4):
                if len(word) > 1 and toxicity._EDGE[word[-1]]:
                    word = word[:-1]
                if len(word) > 1 and toxicity._EDGE[word[0]]:
                    word = word[1:]
            found.add(span_hash(word) % toxicity.BUCKETS)
            found |= {span_hash(word[:n], n) % toxicity.BUCKETS for n in toxicity._STEMS if len(word) > n}
        none += np.logaddexp(0, model.bias + sum(weights.get(f, 0.0) for f in found))
    return -math.expm1(-none)
