"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments, and an index holds every code under each of its segment values. Two codes at
Hamming distance d agree in some segment up to d // m bits, so a query looks up all segment values within a small
radius, and one segment's radius grows by one at a time. Once the radii r_1..r_m of all segments satisfy
sum(r_i + 1) - 1 >= the k-th distance found, nothing closer can be missing and the query is finished; the others go on.
The number of segments follows the size of the index (a segment of about log2(n) bits, so a value has about one code).

The index is dealt into blocks of up to about two million codes, and the queries into chunks. A task holds one block in numpy
arrays and grows the radii of each query of one chunk on its own, so the driver sees counts only and the number of jobs
does not depend on the distances. With several blocks, the codes that the smallest radii meet in all of them first give
a bound on each query's k-th distance.

Equal codes are one entry with their k least ids, found with a first pass over salted shares of a code, so a code that
very many rows have is neither expanded nor brought into one task whole.

Defined cases: rows without an id or a vector take no part; missing or NaN elements count as 0; a vector is its own
nearest neighbour; equal distances are ordered by id; with fewer than k rows a query has them all; an empty index or
no queries give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import batch, sized, store

K, BITS = 10, 64
_SHARES = 16
#: Codes of one block of the index (about 100 bytes each in a task), and of one packed row.
BLOCK, ROWS = 1 << 21, 1 << 14
#: Queries of a chunk at least, and chunks at most: a block goes to the task of each chunk.
CHUNK, CHUNKS = 4096, 16
#: Codes compared at once.
CANDIDATES = 1 << 20
_ENTRY = pa.schema([("block", pa.int32()), ("code", pa.int64()), ("ids", pa.list_(pa.int64()))])


def sign_codes(vectors: pa.Array) -> pa.Array:
    """64 sign bits of each vector: of its elements if it has 64, else of 64 fixed random projections."""
    out = np.zeros(len(vectors), np.uint64)
    lengths = np.array(vectors.value_lengths().fill_null(0))
    ends = np.cumsum(lengths)
    flat = vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = np.nan_to_num(flat[(ends[rows] - d)[:, None] + np.arange(d)].astype(np.float32), posinf=1.0, neginf=-1.0)
        if d != BITS:
            x = x @ np.random.default_rng(d).standard_normal((d, BITS)).astype(np.float32)
        out[rows] = np.packbits(x > 0, axis=1, bitorder="little").view("<u8").ravel()
    return pa.array(out.astype(np.int64), mask=np.array(vectors.is_null()))


def segments(n: int) -> int:
    """Number of segments, of 4, 8 or 16, whose length is closest to log2(n)."""
    return min((4, 8, 16), key=lambda m: (abs(BITS / m - max(1, n).bit_length()), m))


def steps(m: int):
    """(segments, radii, distance covered) in the order of growth: small radii for all segments at once, then one segment a step."""
    length = BITS // m
    yield range(m), (0, 1) if length > 1 else (0,), 2 * m - 1
    yield range(m), (2,), 3 * m - 1
    for r in range(3, length + 1):
        for j in range(m):
            yield (j,), (r,), m * r + j


class Growth:
    """The flipped bits of all steps in their order: ``places`` and ``masks`` one entry a lookup, ``ends`` and ``covered`` one a step."""

    def __init__(self, m: int):
        self.length = BITS // m
        bits = np.bitwise_count(np.arange(1 << self.length, dtype=np.uint32))
        by_radius = [np.flatnonzero(bits == r) for r in range(self.length + 1)]
        parts = [(j, by_radius[r], at) for at, (which, radii, _) in enumerate(steps(m)) for r in radii for j in which]
        sizes = [len(masks) for _, masks, _ in parts]
        self.places = np.repeat([j for j, _, _ in parts], sizes)
        self.masks = np.concatenate([masks for _, masks, _ in parts]).astype(np.int32)
        self.covered = [c for *_, c in steps(m)]
        self.ends = np.cumsum(np.bincount([at for *_, at in parts], sizes, len(self.covered))).astype(int).tolist()


class SegmentIndex:
    """The codes of a block under each of their segment values, and the number and the least of the ids of each code."""

    def __init__(self, codes: np.ndarray, number: np.ndarray, least: np.ndarray, m: int):
        self.own, self.number, self.least, self.growth = codes, number, least, Growth(m)
        length, counts, rows = self.growth.length, [], []
        self.offsets, self.shifts, self.low = np.arange(m, dtype=np.int32) << length, np.arange(m, dtype=np.uint64) * np.uint64(length), np.uint64((1 << length) - 1)
        for j in range(m):
            values = ((codes >> self.shifts[j]) & self.low).astype(np.uint16)
            counts.append(np.bincount(values, minlength=1 << length))
            rows.append(np.argsort(values, kind="stable").astype(np.int32))
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)  # by segment, then value
        self.rows = np.concatenate(rows)
        self.codes = codes[self.rows]

    def _below(self, query: np.uint64, far: int, first: int, last: int) -> list:
        """(rows, distances) of the codes within ``far`` that the lookups first..last lead to; a code may come once a segment."""
        own = self.offsets + ((query >> self.shifts) & self.low).astype(np.int32)
        keys = own[self.growth.places[first:last]] ^ self.growth.masks[first:last]
        start = self.starts[keys]
        size = self.starts[keys + 1] - start
        found, ends = [], np.cumsum(size, dtype=np.int32)
        for a, b in _slices(ends):
            before = ends[a - 1] if a else np.int32(0)
            at = np.repeat((start[a:b] - (ends[a:b] - size[a:b] - before)).astype(np.int64), size[a:b])
            at += np.arange(len(at))
            apart = self.codes[at]
            apart ^= query
            apart = np.bitwise_count(apart)
            near = np.flatnonzero(apart <= far)
            found.append((self.rows[at[near]], apart[near]))
        return found

    def _scan(self, query: np.uint64, far: int) -> list:
        apart = np.bitwise_count(self.own ^ query)
        near = np.flatnonzero(apart <= far)
        return [(near.astype(np.int32), apart[near])]

    def search(self, query: np.uint64, k: int, bound: int = BITS, only_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the first codes by distance and least id that hold the k nearest ids of the block within ``bound``.

        The radii grow until all codes as near as the k-th id so far must have been met: to a known bound at once, else first by
        steps, then to the distance before the k-th so far. With more values to look up than codes, the codes are gone through instead."""
        growth, far, at, covered = self.growth, bound, 0, -1
        rows, dist = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        while covered < far:
            upto = at
            while upto + 1 < len(growth.covered) and growth.covered[upto] < (far if bound < BITS else far - 1 if at > 1 and far < BITS else 0):
                upto += 1
            if growth.ends[upto] > len(self.own) and not only_first:
                found, covered = self._scan(query, far), BITS
            else:
                found = self._below(query, far, growth.ends[at - 1] if at else 0, growth.ends[upto])
                at, covered = upto + 1, growth.covered[upto] if upto + 1 < len(growth.covered) else BITS
            more, apart = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found))
            if len(more):
                if len(more) > (enough := len(self.shifts) * k):  # so many hold k codes at least
                    least = int(np.searchsorted(np.cumsum(np.bincount(apart)), enough))
                    near = np.flatnonzero(apart <= least)
                    more, apart = more[near], apart[near]
                rows, first = np.unique(np.concatenate([rows, more]), return_index=True)
                dist = np.concatenate([dist, apart])[first]
                order = np.lexsort((self.least[rows], dist))[:k]  # the k nearest ids are of the k first codes by distance and least id
                rows, dist = rows[order], dist[order]
                full = int(np.searchsorted(np.cumsum(self.number[rows]), k))
                far = min(far, int(dist[full])) if full < len(dist) else far
            if only_first:
                break
        return rows, dist


def _slices(ends: np.ndarray):
    """Stretches of lookups with about CANDIDATES codes each; a lookup is never cut."""
    a = 0
    while a < len(ends):
        b = len(ends) if ends[-1] - (before := ends[a - 1] if a else 0) <= CANDIDATES else max(a + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
        yield a, b
        a = b


def entries(index: DataFrame, k: int = K) -> DataFrame:
    """(code, ids): the k least ids of each code."""
    shared = Window.partitionBy("code", "share").orderBy("id")
    some = index.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(_SHARES))).withColumn("place", F.row_number().over(shared)).filter(F.col("place") <= k)
    least = some.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("place") <= k)
    return least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, codes, number, ids): the codes of a block dealt by hash, some thousands a row, with the number of ids of each and the ids."""
    def tables(batches):
        held, n = [], 0
        for some in batches:
            held, n = [*held, some], n + some.num_rows
            if n >= BLOCK:
                yield pa.Table.from_batches(held, _ENTRY)
                held, n = [], 0
        yield pa.Table.from_batches(held, _ENTRY)

    def pieces(table):
        order, dealt = np.argsort(at := table["block"].to_numpy(), kind="stable"), np.bincount(at, minlength=blocks)
        table = table.take(pa.array(order))
        for block, (start, n) in enumerate(zip(np.cumsum(dealt) - dealt, dealt.tolist())):
            for a in range(start, start + n, ROWS):
                some = table.slice(a, min(ROWS, start + n - a)).combine_chunks()
                ids = some["ids"].combine_chunks()
                yield batch(("block", "codes", "number", "ids"), pa.array([block], pa.int32()), [some["code"].to_numpy().tobytes()],
                            [np.array(ids.value_lengths()).astype(np.uint16).tobytes()], [ids.flatten().to_numpy().astype(np.int64).tobytes()])

    def run(batches):
        for table in tables(batches):
            yield from pieces(table)

    return rows.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), "code", "ids").mapInArrow(run, "block int, codes binary, number binary, ids binary")


def _search(k: int, only_first: bool):
    """Of a block and a chunk of queries, with only_first (query, dists): the k least distances that the first step meets; else (query, neighbor_id, dist) of the k nearest ids within the bounds."""
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        codes, number, ids = (np.frombuffer(b"".join(block[c].to_pylist()), kind) for c, kind in (("codes", np.uint64), ("number", np.uint16), ("ids", np.int64)))
        queries, bounds = asked["query"].to_numpy(), asked["bound"].to_numpy()
        starts = np.cumsum(number, dtype=np.int64) - number
        index = SegmentIndex(codes, number, ids[starts], segments(len(codes)))
        found = [index.search(q, k, int(bound), only_first) for q, bound in zip(queries.astype(np.uint64), bounds)]
        sizes = [len(rows) for rows, _ in found]
        rows, dist = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.uint8)]).astype(np.int64) for i in (0, 1))
        of = np.repeat(np.arange(len(found)), sizes)
        total = np.cumsum(many := number[rows].astype(np.int64))
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts[rows] - (total - many), many)
        of, dist = np.repeat(of, many), np.repeat(dist, many)
        order = np.lexsort((ids[at], dist, of))
        of, dist, near = of[order], dist[order], ids[at][order]
        first = np.searchsorted(of, of)
        kept = np.arange(len(of)) - first < k
        if only_first:
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(found)))])
            return pa.table({"query": queries, "dists": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(dist[kept], pa.int32()))})
        return pa.table({"query": queries[of[kept]], "neighbor_id": near[kept], "dist": pa.array(dist[kept], pa.int32())})

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) for every row of ``queries`` against all rows of ``index`` (both: id, code)."""
    known, n = sized(entries(index, k))
    blocks = -(-n // BLOCK) or 1
    packed = _packed(known, blocks)
    wanted, asked = sized(queries.select(F.col("code").alias("query")).distinct())
    chunks = min(CHUNKS, -(-asked // CHUNK)) or 1

    def met(bounded: DataFrame, only_first: bool, schema: str) -> DataFrame:
        """Every block meets every chunk of the queries in a task."""
        left = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        right = bounded.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_search(k, only_first), schema)

    bounded = wanted.withColumn("bound", F.lit(BITS))
    if blocks > 1:
        # what the smallest radii meet in all blocks bounds the k-th distance, so that no block goes as far as its own k-th
        first = met(bounded, True, "query long, dists array<int>").groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("dists"))).alias("dists"))
        bounded = store(first.select("query", F.when(F.size("dists") >= k, F.try_element_at("dists", F.lit(k))).otherwise(F.lit(BITS)).alias("bound")))
    near = met(bounded, False, "query long, neighbor_id long, dist int")
    lists = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "neighbor_id"))).filter(F.col("rank") <= k)
    asked_by = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asked_by.join(lists, "query").select("query_id", "neighbor_id", F.col("dist").alias("distance"), "rank")


def coded(vectors: DataFrame) -> DataFrame:
    """(id, code) of the rows of (vec_id, embedding) that have both."""
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.select("id", F.arrow_udf(sign_codes, "bigint")("embedding").alias("code"))


def exact_top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """Top-k by sign codes for every row whose id is divisible by 20, against all rows."""
    rows = store(coded(vectors))
    return top_k(rows, rows.filter(F.col("id") % 20 == 0), k)


#: The same result by comparing all elements' signs; vectors have 64 elements.
SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS "rank" FROM d)
SELECT query_id, neighbor_id, distance, "rank" FROM r WHERE "rank" <= 10
"""
