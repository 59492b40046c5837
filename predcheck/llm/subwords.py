"""Subword ids of words under a public BPE vocabulary with word ends, with a bounded cache.

The vocabulary splits at white space before it merges, so a text's ids are its words' ids in order. Words repeat, so
each distinct word is encoded once per worker and looked up afterwards. Plain words are merged by the vocabulary's own
merge ranks in a byte-pair encoder; every other word goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Bytes of cached words and ids, with ENTRY bytes for each, that a worker keeps before it starts afresh.
CACHE_BYTES, ENTRY = 128 << 20, 200

#: Fixed values of the vocabulary file: its split pattern and its mark for the end of a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordIds(dict):
    """word (bytes) -> its ids as little-endian 32-bit numbers (bytes); fills itself."""

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        spec = json.loads(open(path, encoding="utf-8").read())
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.whole = Tokenizer.from_file(path)
        self.special = tuple(x["content"].encode() for x in spec.get("added_tokens", []))
        of, end = _printable_bytes(), b"\xff"  # 0xFF never occurs in UTF-8

        def raw(token: str) -> bytes:
            ended = token.endswith(WORD_END)
            return bytes(of[c] for c in token.removesuffix(WORD_END)) + end * ended

        # a byte and the word end join first, then pairs in the order of the vocabulary's merges
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(255)}
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        ids = {raw(t): i for t, i in vocabulary.items() if t.encode() not in self.special}
        self.id_of = [ids.get(token, 0) for token in sorted(ranks, key=ranks.get)].__getitem__
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, word: bytes) -> bytes:
        if self.held >= CACHE_BYTES:
            self.clear()
        text = word.decode()
        if text.isascii():
            if text.isalpha():
                out = array("I", map(self.id_of, self.piece(word.lower() + b"\xff"))).tobytes()
            elif text[:-1].isalpha() and text[-1] in ".,;:!?":  # two parts that the vocabulary splits anyway
                out = self[word[:-1]] + self._marks(text[-1])
            elif b"<|" not in word:
                out = self._merged(text)
            else:
                out = self._encoded(text)
        elif max(text) < "ɐ" and b"<|" not in word and "\x85" not in text and "\xa0" not in text:
            out = self._merged(text)
        else:  # characters with other normal forms, and strings of special tokens
            out = self._encoded(text)
        self[word] = out
        self.held += len(word) + len(out) + ENTRY
        return out

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def _marks(self, text: str) -> bytes:
        return array("I", map(self.id_of, self.piece(text.encode() + b"\xff"))).tobytes()

    def _merged(self, text: str) -> bytes:
        return b"".join(self._marks(part) for part in self.split(text.lower()))

    def _encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this worker for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
