"""Two tokenizations of one text laid side by side: which tokens overlap, and where both have a border.

The text is cut at spaces that no white space precedes. Neither vocabulary has a token across such a space (``Pair`` checks the pieces when it is loaded), so
each unit has its ids whatever stands around it, and a worker encodes a repeated unit once. The ids of a batch are then laid out by document,
``pandas.merge_asof`` finds for each token's start the token of the other side that covers it, keyed by document, and the union of both directions is every
overlap: of two overlapping tokens one starts within the other. Ends that both sides have cut the groups.

How many documents hold a pair of ids linked is counted by Spark over all documents; the counts, one row for each pair that occurs, are
sent to every executor only if they are counted as few, and met by a shuffle otherwise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from .subwords import _printable_bytes
from .tables import batch, sized, store, text_of
from .text import chunks, pieces

#: Units, and bytes of units, that a task keeps; bytes of text that are aligned at a time. None changes a result.
KEPT_UNITS, KEPT_BYTES, ALIGN_BYTES = 300_000, 24 << 20, 1 << 21
#: Pairs of ids that may be sent to every executor (about 30 bytes each).
BROADCAST_PAIRS = 4_000_000

#: Bytes of units that are encoded together.
JOINED = 1 << 14
#: Fixed values of the vocabularies: the split pattern of byte-level files, and the character for a space in pieces.
PATTERN, SPACE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", "\u2581"

_COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Pair:
    """The two tokenizers: ids of units with the space before each, bytes and decimal text of each id."""

    def __init__(self, a_path: str, b_path: str):
        spec = json.loads(open(a_path, encoding="utf-8").read())
        vocabulary, special = dict(spec["model"]["vocab"]), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = _printable_bytes()
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.a_bytes = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.a_bytes[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_of = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.b_bytes = np.array([len(x) for x in self.b_of])
        self.space = self.b.piece_to_id(SPACE)
        # a unit's ids stand for themselves only if no piece goes on after a space that follows something else
        self.apart = not any(SPACE in n.lstrip(SPACE) for i, n in enumerate(names) if not self.b.is_control(i))
        texts = [f"{i}{end}" for n, ends in ((size, ",|"), (len(names), ",;")) for i in range(n) for end in ends]
        self.texts, self.b_text = pa.array(texts, pa.large_binary()), 2 * size

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both sides of a space and ``text``, and whether the second side gives these bytes back."""
        a = np.asarray(self.a.encode_to_numpy(" " + text, disallowed_special=()), np.int32)
        b = self.b.encode(text, num_threads=1) if text else [self.space]
        return a, np.array(b, np.int32), b"".join(map(self.b_of.__getitem__, b)) == b" " + text.encode()

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each side the ids of all units end to end and how many each has; and whether each unit is whole.

        Units that end in a character are encoded many at a time, joined by the spaces they were cut at, the others one by one."""
        flat, sizes, whole = ([], []), ([], []), []

        def alone(unit):
            a, b, ok = self._ids(unit)
            for side, ids in enumerate((a, b)):
                flat[side].append(ids)
                sizes[side].append(np.array([len(ids)]))
            whole.append(np.array([ok]))

        lo = 0
        while lo < len(units):
            hi, size = lo, 0
            while hi < len(units) and size < JOINED and units[hi] and not units[hi][-1].isspace():
                size += len(units[hi])
                hi += 1
            if hi - lo > 1:
                ends = np.cumsum([len(u.encode()) + 1 for u in units[lo:hi]])
                a, b, ok = self._ids(" ".join(units[lo:hi]))
                if ok:
                    for side, (ids, width) in enumerate(((a, self.a_bytes), (b, self.b_bytes))):
                        flat[side].append(ids)
                        sizes[side].append(np.diff(np.searchsorted(np.cumsum(width[ids]), ends, side="right"), prepend=0))
                    whole.append(np.ones(hi - lo, bool))
                else:
                    for unit in units[lo:hi]:
                        alone(unit)
            else:
                hi = lo + 1
                alone(units[lo])
            lo = hi
        return [np.concatenate(x) for x in flat], [np.concatenate(x) for x in sizes], np.concatenate(whole)


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def unit_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the spaces that begin a unit: those after a byte that surely ends no white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[~np.isin(at, offsets)]  # the first byte of a text has nothing before it
    one = data[at - 1].astype(np.int64)
    two, three = (np.where(at >= n, data[at - np.minimum(at, n)], 0) for n in (2, 3))
    white = (one <= 0x20) | (two == 0xC2) | ((one >= 0x80) & (three >= 0xE1) & (three <= 0xE3))  # the second and third also hold some letters
    return at[~white]


class _Numbers(dict):
    """Numbers units in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Units:
    """Units met so far, by number: ids of both sides laid end to end, and whether they are whole."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number, self.bytes, self.whole = _Numbers(), 0, np.zeros(0, bool)
        self.ids, self.at = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct units, those new to the task encoded together."""
        if len(self.number) > KEPT_UNITS or self.bytes > KEPT_BYTES:
            self.clear()
        numbers = np.fromiter(map(self.number.__getitem__, words.to_pylist()), np.int64, len(words))
        if new := self.number.new:
            flat, sizes, whole = self.pair.encode(new)
            self.bytes += sum(map(len, new))
            self.whole = np.concatenate([self.whole, whole])
            for s in (0, 1):
                self.ids[s] = np.concatenate([self.ids[s], flat[s]])
                self.at[s] = np.concatenate([self.at[s], self.at[s][-1] + np.cumsum(sizes[s])])
            new.clear()
        return numbers

    def tokens(self, side: int, units: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
        """The tokens of a row of units: id, doc, start and end byte (units laid end to end), number within the batch."""
        first, n = self.at[side][units], self.at[side][units + 1] - self.at[side][units]
        ids = self.ids[side][np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
        end = np.cumsum((self.pair.b_bytes if side else self.pair.a_bytes)[ids])
        return pd.DataFrame({"start": np.concatenate([[0], end[:-1]])[:len(end)], "doc": np.repeat(doc, n), "id": ids, "end": end, "n": np.arange(len(end))}, copy=False)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of both sides of all overlapping pairs, each pair once."""
    covering = pd.merge_asof(a[["start", "doc", "n"]], b[["start", "doc", "n"]], on="start", by="doc", suffixes=("_a", "_b"))
    covered = pd.merge_asof(b[["start", "doc", "n"]], a.assign(at=a["start"])[["start", "doc", "n", "at"]], on="start", by="doc", suffixes=("_b", "_a"))
    covered = covered[covered["at"] < covered["start"]]  # equal starts are in the first direction
    return (np.concatenate([covering["n_a"].to_numpy(), covered["n_a"].to_numpy()]), np.concatenate([covering["n_b"].to_numpy(), covered["n_b"].to_numpy()]).astype(np.int64))


def _group_text(pair: Pair, a: pd.DataFrame, b: pd.DataFrame, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """All ids as text in order of their groups, where each token's text begins, and the document of each token."""
    of_a, of_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b  # the group of each token
    to_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, side="left")
    to_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")
    which, doc = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    which[to_a], which[to_b] = 2 * a["id"].to_numpy() + cut_a, pair.b_text + 2 * b["id"].to_numpy() + cut_b
    doc[to_a], doc[to_b] = a["doc"].to_numpy(), b["doc"].to_numpy()
    text = pair.texts.take(pa.array(which))
    _, at, data = text.buffers()
    return memoryview(data or b""), np.frombuffer(at, np.int64)[:len(which) + 1], doc


def _aligned(units: Units, numbers: np.ndarray, doc: np.ndarray, docs: int):
    """(four counts by document, text of its groups by document, and document, pair of ids and times of all links)."""
    pair = units.pair
    a, b = units.tokens(0, numbers, doc), units.tokens(1, numbers, doc)
    left, right = overlaps(a, b)
    ends = [np.zeros(int(a["end"].max() if len(a) else 0) + 1, bool) for _ in range(2)]
    for mark, side in zip(ends, (a, b)):
        mark[side["end"].to_numpy()] = True
    cut_a, cut_b = ends[1][a["end"].to_numpy()], ends[0][b["end"].to_numpy()]
    doc_a, size_b = a["doc"].to_numpy(), len(pair.b_bytes)
    counts = np.stack([np.bincount(x, minlength=docs) for x in (doc_a, b["doc"].to_numpy(), doc_a[cut_a], doc_a[left])])
    data, at, of = _group_text(pair, a, b, cut_a, cut_b)
    border = at[np.searchsorted(of, np.arange(docs + 1))]
    keys = a["id"].to_numpy().astype(np.int64)[left] * size_b + b["id"].to_numpy()[right]
    span = np.int64(len(pair.a_bytes)) * size_b
    linked, times = np.unique(doc_a[left] * span + keys, return_counts=True)
    return counts, [data[x:y] for x, y in zip(border[:-1].tolist(), border[1:].tolist())], linked // span, linked % span, times


def _chunk_rows(units: Units, data: np.ndarray, offsets: np.ndarray):
    """Counts (4, documents), digests, and document, pair and times of the links of a chunk of texts."""
    docs = len(offsets) - 1
    whole = np.diff(offsets) > 0
    borders = unit_borders(data, offsets) if units.pair.apart else np.zeros(0, np.int64)
    starts = np.concatenate([borders + 1, offsets[:-1][whole]])
    order = np.argsort(starts, kind="stable")  # an empty unit at the end of a text comes before the next text
    doc = np.concatenate([np.searchsorted(offsets, borders, side="right") - 1, np.flatnonzero(whole)])[order]
    starts = starts[order]
    keep = np.ones(len(data), bool)
    keep[borders] = False
    # a border's space is not part of a unit; every other byte is part of the unit that began last
    at = (starts - np.searchsorted(borders, starts - 1, side="right")) if len(starts) else starts
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(at, int(keep.sum())).astype(np.int64)), pa.py_buffer(data[keep]))
    counts, digests, links = np.zeros((4, docs), np.int64), [hashlib.sha256() for _ in range(docs)], []
    written = np.zeros(docs, bool)
    weights = np.append(0, np.cumsum(np.diff(np.append(at, int(keep.sum()))) + 1))
    numbered, bad = [], np.zeros(docs, bool)
    parts = list(pieces(weights, ALIGN_BYTES))
    for lo, hi in parts:  # a very long text is aligned unit by unit, in as many steps as it needs
        coded = words.slice(lo, hi - lo).dictionary_encode()
        numbers = units.numbers(coded.dictionary)[coded.indices.to_numpy()]
        bad[doc[lo:hi][~units.whole[numbers]]] = True
        if len(parts) > 1:  # whether a text is whole is known only after its last unit: align what is known to be whole so far
            numbered.append((lo, hi))
            continue
        links += _segment(units, numbers, doc[lo:hi], bad, docs, counts, digests, written)
    for lo, hi in numbered:
        coded = words.slice(lo, hi - lo).dictionary_encode()
        links += _segment(units, units.numbers(coded.dictionary)[coded.indices.to_numpy()], doc[lo:hi], bad, docs, counts, digests, written)
    return counts, [d.hexdigest() if w else "" for d, w in zip(digests, written)], links


def _segment(units, numbers, doc, bad, docs, counts, digests, written) -> list:
    keep = ~bad[doc]
    more, texts, of, key, times = _aligned(units, numbers[keep], doc[keep], docs)
    counts += more
    for i, text in enumerate(texts):
        if len(text):
            digests[i].update(b";" + bytes(text[:-1]) if written[i] else text[:-1])
            written[i] = True
    return [(of, key, times)]


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_pair(a_path, b_path))
        for b in batches:
            for part, data, offsets in chunks(b, limit=ALIGN_BYTES):
                counts, digests, links = _chunk_rows(units, data, offsets)
                of, key, times = (np.concatenate([x[i] for x in links] or [np.zeros(0, np.int64)]) for i in range(3))
                if len(links) > 1:  # the pairs of the steps of a long text, added up
                    order = np.lexsort((key, of))
                    of, key, times = of[order], key[order], times[order]
                    at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])) if len(of) else of
                    of, key, times = of[at], key[at], np.add.reduceat(times, at) if len(at) else times
                at = pa.array(np.searchsorted(of, np.arange(len(digests) + 1)).astype(np.int32))
                yield batch(("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"), part.column(0), part.column(1),
                            *counts.astype(np.int64), pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, pa.array(key)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))))
    return run


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(one row per document with its counts, digest and linked pairs of ids; the corpus-wide table of pairs; its rows).

    A pair is the number ``a * size of the second vocabulary + b``. The second table has ``pair``, ``n_docs`` and ``best``, whether no pair of the same
    first id is in more documents. Both are stored."""
    a_path, b_path = paths or default_paths()
    rows = text_of(docs, "doc_id").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = store(rows.mapInArrow(_align(a_path, b_path), _COLUMNS))
    held = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    of_a = Window.partitionBy(F.expr(f"pair div {_pair(a_path, b_path).b.get_piece_size()}"))  # at most the second vocabulary's size
    pairs, number = sized(held.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(of_a)).alias("best")))
    return aligned, pairs, number


def token_alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose tokens do not give back the text with a space before it, has no tokens: zeros and an empty string. Repeated rows
    and repeated or null ids are documents of their own. Strings of special tokens are plain text. A text of any length is aligned in steps of ALIGN_BYTES;
    an empty table gives an empty result, further columns of any name are ignored. Among pairs of one first id that are in equally many documents all are best.
    """
    aligned, pairs, number = align_tokens(docs, paths)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = F.broadcast(pairs) if number <= BROADCAST_PAIRS else pairs
    sums = links.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
