"""Document fingerprints of closed syncmers with positions.

A k-mer of a text's bytes is an anchor (a closed syncmer) when the least of its s-mers, in a fixed random order, is its
first or last one. Whether a k-mer is an anchor depends on the k-mer alone, so an edit changes only the anchors it
touches. A fingerprint keeps the ANCHORS distinct anchors of least hash, each with the place where it first occurs.
The likeness of two fingerprints is Dice's coefficient of their anchors over the range of hashes that both cover
completely; an anchor counts as common if both have it at places that agree on one shift.

To edit a text with the next document's beginning, documents are dealt to blocks of neighbouring ids. Block borders
are ids of the data, and the document at a border also goes, as a tail, to the block before; texts are shuffled once.

Defined cases: a null text is empty; a null doc_id comes first; equal ids are ordered by their text; an empty text has
an empty fingerprint, as like as 1 to another empty one and 0 to the rest; a text of under SHORT bytes has all its 3-mers as
anchors;a lone document is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import batch, text_of
from .text import mix

K, S = 6, 3
SHORT = 24
ANCHORS = 64
#: Matching anchors may differ in their shift by this many bytes.
BAND = 8
#: Documents of a block on average, and the most blocks (their borders are one bounded list).
BLOCK_ROWS, MOST_BLOCKS = 512, 50_000
#: Least hashes looked at first, as a multiple of ANCHORS, before all anchors of a text are sorted.
_FIRST_LOOK = 12

EMPTY = (np.zeros(0, np.uint32), np.zeros(0, np.uint32))


def anchors(text: bytes, n_anchors: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, first places) of the closed syncmers of least hash."""
    n = len(text)
    if n == 0:
        return EMPTY
    if n < SHORT:
        padded = np.frombuffer(text.ljust(3, b"\0"), np.uint8).astype(np.uint64)
        gram = padded[:-2] | (padded[1:-1] << np.uint64(8)) | (padded[2:] << np.uint64(16)) | np.uint64(1 << 60)
        distinct, first = np.unique((mix(gram) >> np.uint64(32)).astype(np.uint32), return_index=True)
        return distinct, first.astype(np.uint32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    inner = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    order = inner * np.uint32(0x9E3779B1)
    order ^= order >> np.uint32(15)
    order *= np.uint32(0x85EBCA77)
    order ^= order >> np.uint32(13)
    span = K - S + 1
    least = np.minimum(order[:-1], order[1:])
    least = np.minimum(least[:-2], least[2:])  # of span = 4 neighbouring s-mers
    at = np.flatnonzero((order[:n - K + 1] == least) | (order[span - 1:] == least))
    kmer = inner[at].astype(np.uint64) | (inner[at + (K - S)].astype(np.uint64) << np.uint64(24))
    h = (mix(kmer) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 2 * _FIRST_LOOK * n_anchors:
        near = np.flatnonzero(h < np.uint32((_FIRST_LOOK * n_anchors << 32) // len(h)))
        distinct, first = np.unique(h[near], return_index=True)
        if len(distinct) >= n_anchors:
            return distinct[:n_anchors], at[near[first[:n_anchors]]].astype(np.uint32)
    distinct, first = np.unique(h, return_index=True)
    return distinct[:n_anchors], at[first[:n_anchors]].astype(np.uint32)


def likeness(a, b, n_anchors: int = ANCHORS) -> float:
    """Dice's coefficient of two fingerprints' anchors in common at one shift, where both are complete."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    reach = min([int(x[-1]) for x in (a[0], b[0]) if len(x) >= n_anchors], default=1 << 32)
    n = int(np.searchsorted(a[0], reach, side="right") + np.searchsorted(b[0], reach, side="right"))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(i) == 0:
        return 0.0
    shift = np.sort(b[1][j].astype(np.int64) - a[1][i].astype(np.int64))
    band = BAND if min(a[1].max(), b[1].max()) >= 8 * BAND else 0
    together = np.searchsorted(shift, shift + band, side="right") - np.arange(len(shift))
    return min(1.0, 2.0 * float(together.max()) / n)


def fingerprint(found) -> str:
    """Hash and place of each anchor, eight hexadecimal digits each."""
    return np.stack(found, axis=1).astype(">u4").tobytes().hex()


def in_order(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (doc_id, text, tail) by block and id; each block ends with the document that follows it (tail)."""
    texts = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    n = docs.count()
    blocks = max(1, min(MOST_BLOCKS, n // block_rows))
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else F.array(F.lit(0.5))
    lowest, nulls, borders = texts.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()),
                                       F.percentile_approx("doc_id", shares, max(10_000, 8 * blocks))).first()
    borders = np.array(sorted(set(borders or []) - {lowest}) if blocks > 1 else [], np.int64)

    def places(ids: pa.Array) -> pa.Array:
        """The blocks a document goes to: its own, and as a tail the one before if it is its block's first."""
        known = np.array(ids.is_valid())
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        own = np.where(known, np.searchsorted(borders, value, side="right"), 0)
        opens = known & (own > 0)
        if len(borders):
            opens &= borders[np.maximum(own - 1, 0)] == value
        first = ~known if nulls else known & (value == lowest if lowest is not None else False)
        lists = [[2 * o] + ([2 * (o - 1) + 1] if p else []) + ([2 * len(borders) + 1] if f else [])
                 for o, p, f in zip(own.tolist(), opens.tolist(), first.tolist())]
        return pa.array(lists, pa.list_(pa.int64()))

    dealt = texts.withColumn("__to", F.explode(F.arrow_udf(places, "array<bigint>")("doc_id")))
    dealt = dealt.withColumns({"block": F.shiftright("__to", 1), "tail": (F.col("__to") % 2 == 1)}).drop("__to")
    return dealt.repartition(F.col("block")).sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def fingerprints(docs: DataFrame, n_anchors: int = ANCHORS) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document's beginning, with likenesses."""
    def run(batches):
        block, held, closed = None, None, False  # held: the document that waits for its next one
        for rows in batches:
            found = []
            for doc, text, to, tail in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if to != block:
                    block, held, closed = to, None, False
                if closed:  # further copies of the tail
                    continue
                text = text or ""
                own = anchors(text.encode(), n_anchors)
                if held is not None:
                    found.append(compared(*held, text, own))
                held, closed = (doc, text, own), tail
            if found:
                yield batch(_NAMES, *(pa.array(c, t) for c, t in zip(zip(*found), _TYPES)))

    def compared(doc, text, own, after, other):
        k = len(text) // 4
        edited = (text[:len(text) - k] + after[:k]).encode()
        marks = anchors(edited, n_anchors)
        return (doc, len(text), hashlib.sha256(edited).hexdigest(), fingerprint(own), fingerprint(marks),
                likeness(own, marks, n_anchors), likeness(own, other, n_anchors))

    return in_order(docs).select("doc_id", "text", "block", "tail").mapInArrow(run, COLUMNS)
