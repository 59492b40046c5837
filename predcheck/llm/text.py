"""Words of Arrow text batches as numpy arrays: starts, ends and 64-bit hashes, without a Python object per word.

All functions work on the raw UTF-8 bytes of a chunk of texts laid end to end. Lower-casing touches A-Z only, and
every separator is ASCII, so a byte view gives the same words as a view of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about this many bytes (one longer text makes a chunk of its own).
CHUNK_BYTES = 1 << 21

_BYTES = np.arange(256)
#: Lower-cases A-Z.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words of ``[^\x20\x09-\x0D]+``: every byte but ASCII white space.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a few chunks."""
    if len(_powers[base]) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size > 4 * CHUNK_BYTES:
            return table[:n]
        _powers[base] = table
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of rows with about ``limit`` bytes together."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch with the bytes and offsets of their text."""
    texts = batch.column(batch.schema.get_field_index(column))
    data, offsets = strings(texts)
    for first, last in pieces(offsets, limit):
        lo, hi = offsets[first], offsets[last]
        yield batch.slice(first, last - first), data[lo:hi], offsets[first:last + 1] - lo


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE):
    """(starts, ends, first): words of all texts in order; words of text i are first[i]..first[i+1]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = word[cut]  # a text's first byte starts a word even if the text before ends inside one
    end[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by differences of one prefix sum."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power_table(_BASE, len(data))
    np.cumsum(terms, out=total[1:])
    h = (total[ends] - total[starts]) * _power_table(_BASE_INVERSE, len(data))[starts]
    return mix(h)


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and how many each text has.

    A text of 1 to k-1 words has one run: its whole sequence. A text without words has none.
    """
    n = len(words)
    counts = np.diff(first)
    grams = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    if n == 0:
        return np.zeros(0, np.uint64), grams
    rolled = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        rolled[:n - j] += words[j:] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
    # of the positions of a text, the first grams[i] start a run that ends within the text
    place = np.arange(n) - np.repeat(first[:-1], counts)
    out = rolled[place < np.repeat(grams, counts)]
    at = np.concatenate([[0], np.cumsum(grams)])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h, factor = 0x2545F4914F6CDD1D * int(counts[i]), 1
        for w in words[first[i]:first[i + 1]].tolist():
            h, factor = (h + w * factor) % (1 << 64), factor * _STEP % (1 << 64)
        out[at[i]] = h
    return mix(out), grams


def run_hashes(words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``lengths`` words that start at ``at``, by differences of one prefix sum."""
    if len(at) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power_table(_BASE, len(words)), out=total[1:])
    return mix((total[at + lengths] - total[at]) * _power_table(_BASE_INVERSE, len(words))[at])


def count_words(texts: pa.Array) -> pa.Array:
    """Number of ``[^\x20\x09-\x0D]+`` words of each text; 0 for a null."""
    data, offsets = strings(texts)
    out = np.zeros(len(texts), np.int64)
    for first, last in pieces(offsets):
        lo = offsets[first]
        _, _, at = word_spans(data[lo:offsets[last]], offsets[first:last + 1] - lo)
        out[first:last] = np.diff(at)
    return pa.array(out)
