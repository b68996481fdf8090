"""Token ids of a public tokenizer, from a cache of the chunks between blanks."""

from __future__ import annotations

import json
import re
import struct
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for a byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the same as ``Tokenizer.encode`` gives.

    For a lower-casing vocabulary that drops white space, no token crosses a blank, so the
    ids of a text are those of its chunks in turn, and chunks repeat. A chunk of Latin letters, perhaps
    with ASCII marks after it, is one word and one run of marks; the model alone encodes those. Any other
    tokenizer file is applied to the whole text.
    """

    LIMIT = 600_000  # entries of either cache; a full one starts anew
    _simple = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]{1,60})([!-/:-@\[-`{-~]*)").fullmatch
    _blank = re.compile(r"[ \t\n\r\f\v]+")
    _separators = re.compile(r"[\x1c-\x1f]").search  # blanks to Python, not to tokenizers

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        kind = json.loads(Path(path).read_text())
        steps = [s.get("type") for s in (kind.get("normalizer") or {}).get("normalizers", [])]
        splits = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self._by_chunk = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and "\\p{L}]+" in splits[0]["pattern"]["Regex"]
            and kind["model"]["end_of_word_suffix"] == "</w>"
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in kind["added_tokens"])
        )
        self._letters = _byte_letters()
        self._packed = [struct.pack("<I", i) for i in range(self._tokenizer.get_vocab_size(with_added_tokens=True))]
        self._chunks: dict[str, bytes] = {}
        self._stems: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the caches, so that an idle worker holds nothing."""
        self._chunks.clear()
        self._stems.clear()

    def _model(self, word: str) -> bytes:
        known = self._stems.get(word)
        if known is None:
            tokens = self._tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self._letters))
            packed = self._packed
            known = b"".join([packed[t.id] for t in tokens])
            if len(self._stems) >= self.LIMIT:
                self._stems.clear()
            self._stems[word] = known
        return known

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        simple = self._simple(chunk)
        if simple:
            out = self._model(simple[1].lower())
            if simple[2]:
                out += self._model(simple[2])
        else:
            out = self._whole(chunk)
        if len(chunk) < 64:
            if len(self._chunks) >= self.LIMIT:
                self._chunks.clear()
            self._chunks[chunk] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not self._by_chunk:
            return self._whole(text)
        get, make = self._chunks.get, self._chunk
        chunks = self._blank.split(text) if self._separators(text) else text.split()
        return b"".join([get(c) or make(c) for c in chunks if c])
