"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

A document's ids, closed by one separator id, are cut only if they exceed a sequence. Pieces are dealt by hash to
groups of a few thousand; each group is packed by best-fit decreasing in one task, where a segment tree over remaining
capacities finds the tightest open sequence in logarithmic time. Sequences that a group could not fill are opened
again and packed together with those of neighbouring groups, so groups cost next to nothing in sequences. Only piece
descriptions (no text, no ids) are shuffled.

Defined cases: a null or empty text is its separator alone; equal rows are packed like different ones; a null doc_id
stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .subwords import default_path, word_ids
from .tables import batch, sized, store, text_of
from .text import chunks

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of a group on average, and groups whose unfilled sequences are packed again together.
GROUP_PIECES, MERGED_GROUPS = 8192, 64
#: A sequence filled to this share is closed after the first pass.
CLOSED = 0.995
_BIN_BITS = 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document, and ``spread``, a hash that deals them."""
    path = tokenizer or default_path()

    def run(batches):
        ids_of = word_ids(path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for rows in batches:
            for part, data, offsets in chunks(rows):
                found = []
                raw, keys = data.tobytes(), part.column(0).to_pylist()
                for i, (doc, lo, hi) in enumerate(zip(keys, offsets[:-1].tolist(), offsets[1:].tolist())):
                    ids = b"".join(map(ids_of.__getitem__, raw[lo:hi].split())) + end
                    for k in range(0, len(ids), 4 * capacity):
                        own = ids[k:k + 4 * capacity]
                        found.append((doc, k // (4 * capacity), k // 4, len(own) // 4, zlib.crc32(own)))
                if found:
                    yield batch(["doc_id", "piece", "start", "length", "ids_crc32"],
                                *(pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))))

    out = text_of(docs, "doc_id").mapInArrow(run, PIECES.rpartition(",")[0])
    return out.withColumn("spread", F.xxhash64("doc_id", "piece", "ids_crc32"))


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of the open bin with the least room of at least ``length``."""
        node, any_ = self.leaves + length, self.any
        while not any_[node]:
            while node & 1:  # a right child: look beyond its parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if any_[2 * node] else 2 * node + 1
        room = node - self.leaves
        which = self.bins[room].pop()
        if not self.bins[room]:
            any_[node] = 0
            node >>= 1
            while node and not (any_[2 * node] or any_[2 * node + 1]):
                any_[node] = 0
                node >>= 1
        return room, which


def best_fit(lengths, capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset, fill by bin) for lengths in descending order."""
    free, fill, bins, offsets = OpenBins(capacity), [], [], []
    for n in lengths:
        found = free.take(n) if n < capacity else None
        if found is None:
            room, which = capacity, len(fill)
            fill.append(0)
        else:
            room, which = found
        bins.append(which)
        offsets.append(fill[which])
        fill[which] += n
        if room > n:
            free.put(room - n, which)
    return bins, offsets, fill


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` without gaps."""
    pieces, n = sized(pieces)
    groups = max(1, -(-n // group_pieces))
    names = [c for c in pieces.columns if c != "spread"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "spread")

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "spread", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, fill = best_fit(rows["length"].tolist(), capacity)
        filled = np.array(fill, np.int64)[np.array(bins, np.int64)]
        return rows.drop(columns=["group"]).assign(sequence_id=(np.int64(keys[0]) << _BIN_BITS) + np.array(bins, np.int64),
                                                   offset=offsets, filled=filled)

    columns = schema + ", spread long, sequence_id long, offset long, filled long"
    first = store(pieces.withColumn("group", F.pmod("spread", F.lit(groups))).groupBy("group").applyInPandas(run, columns))
    done = F.col("filled") >= int(CLOSED * capacity)
    again = first.filter(~done).withColumn("group", groups + F.floor(F.shiftright("sequence_id", _BIN_BITS) / MERGED_GROUPS)) \
        .select(*names, "spread", "group").groupBy("group").applyInPandas(run, columns)
    return first.filter(done).unionByName(again).select(*names, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, tokenizer))
