"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct five-word shingles. Grams are ordered by their estimated document frequency,
rarest first; two sets of similarity t share a gram among the first n - ceil(t n) + 1 grams of each, so only those
prefixes are joined. A pair that meets on a prefix gram must have compatible sizes (length filter), enough grams left
from there on (positional filter), and few enough differences outside: each set's parity bitmap bounds the size of the
symmetric difference from below (suffix filter). Pairs that pass are verified once, on whole sets.

Frequencies come from a count sketch over all documents, whose size is bounded; any estimate orders grams validly, as
it is the same for every document. Documents with equal sets are joined once, through the one of least id.

Groups of one gram never become all their pairs. In a few rounds, rows of a group are compared at distances 1, 4, 16, ...
in changing order; of the candidate pairs across components, only a spanning forest is verified, and the links join
components. The first round takes only pairs whose bitmaps are clearly close, so that nearly all of its forest holds:
families of near copies come together at about one verification a document. At last, only groups that still hold several
components are compared in full, each group's rows outside its largest component against all its rows, and all that passes the filters is
verified: no link between components is lost. Groups of many rows are dealt to several tasks in all rounds.

Defined cases: a text without words (or null) has no grams, links with nothing and is its own component; a text of one
to four words is one gram, its whole sequence; rows of one doc_id with different texts are one document that links
through any of them; a null doc_id links with nothing and has a null component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components, forest
from .tables import batch, broadcast_if, sized, store, text_of
from .text import LOWER, chunks, gram_hashes, mix, word_hashes, word_spans

WORDS = 5
#: Similarity of at least PERCENT / 100.
PERCENT = 80
#: Rows of one gram that a task takes at once.
GROUP_ROWS = 8192
#: Bits of a set's parity bitmap. The closer their number is above the differences allowed, the more pairs pass in vain.
BITMAP_BITS = 2048
#: Share of the differences allowed that the first round takes as clearly close, and further rounds before the last.
CLOSE, ROUNDS = 0.75, 2
_SLICES = 64


def sketch_bits(n_docs: int) -> int:
    """Counters of the frequency sketch, as a power of two: at most 4 million (16 MB)."""
    return max(14, min(22, int(n_docs).bit_length() + 2))


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    starts, ends, first = word_spans(data, offsets)
    grams, counts = gram_hashes(word_hashes(LOWER[data], starts, ends), first, k)
    at = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(grams[at[i]:at[i + 1]]) for i in range(len(counts))]


def digest(grams: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    if len(grams) == 0:
        return 0
    return int((mix(grams ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64) ^ np.uint64(len(grams))).astype(np.int64))


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the number of grams in each of BITMAP_BITS buckets; two sets' bitmaps differ in no more places than the sets."""
    places = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (BITMAP_BITS - 1), minlength=BITMAP_BITS)
    return np.packbits((places & 1).astype(np.uint8)).tobytes()


def needed(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Least intersection of sets of these sizes at the similarity asked for."""
    both = (n_a + n_b).astype(np.int64) * PERCENT
    return -(-both // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def passes(n_a, at_a, bits_a, n_b, at_b, bits_b, share: float = 1.0) -> np.ndarray:
    """Length, positional and suffix filters for pairs that share the grams at places ``at_a`` and ``at_b``; ``share`` of
    the differences allowed may show in the bitmaps."""
    least = needed(n_a, n_b)
    ok = (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * PERCENT) & (1 + np.minimum(n_a - at_a, n_b - at_b) - 1 >= least)
    where = np.flatnonzero(ok)
    apart = np.bitwise_count(bits_a[where] ^ bits_b[where]).sum(1, dtype=np.int64)
    ok[where] = apart <= share * (n_a + n_b - 2 * least)[where]
    return ok


# ---------------------------------------------------------------------------------------------- sets and prefixes

def profile(docs: DataFrame, bits: int) -> DataFrame:
    """Per document its set's size, digest and bitmap (slice null), and slices of the frequency sketch (doc_id null)."""
    def run(batches):
        counters, none = np.zeros(1 << bits, np.uint32), np.zeros(0, np.uint64)
        for rows in batches:
            for part, data, offsets in chunks(rows):
                sets = gram_sets(data, offsets)
                np.add.at(counters, (np.concatenate([*sets, none]) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                yield batch(names, part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()),
                            pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()))
        if counters.any():
            own = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(np.split(counters, _SLICES)) if c.any()]
            n = len(own)
            yield batch(names, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                        pa.array([i for i, _ in own], pa.int32()), pa.array([c for _, c in own], pa.binary()))

    names = ["doc_id", "n", "digest", "bits", "slice", "counts"]
    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n long, digest long, bits binary, slice int, counts binary")


def frequencies(profiled: DataFrame, bits: int) -> np.ndarray:
    """The sketch summed over all partitions, slice by slice: 2**bits counters (a bounded table)."""
    size = (1 << bits) // _SLICES

    def add(keys: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint64)
        for rows in tables:
            for c in rows.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        yield batch(["slice", "counts"], pa.array([keys[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()))

    slices = profiled.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint32)
    for row in slices:
        out[row["slice"] * size:(row["slice"] + 1) * size] = np.frombuffer(row["counts"], np.uint32)
    return out


def prefixes(docs: DataFrame, sketch: np.ndarray, bits: int) -> DataFrame:
    """(gram, node, n, at): each set's rarest grams with their places in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts = shared.value
        for rows in batches:
            for part, data, offsets in chunks(rows):
                grams, nodes, sizes, places = [], [], [], []
                for doc, s in zip(part.column(0).to_pylist(), gram_sets(data, offsets)):
                    if len(s):
                        p = prefix_length(len(s))
                        rarity = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                        order = np.argsort(rarity, kind="stable")[:p]  # grams are sorted, so ties are by hash
                        grams.append(s[order])
                        nodes.append(np.full(p, doc))
                        sizes.append(np.full(p, len(s), np.int32))
                        places.append(np.arange(p, dtype=np.int32))
                if grams:
                    yield batch(["gram", "node", "n", "at"], np.concatenate(grams).astype(np.int64), np.concatenate(nodes), np.concatenate(sizes), np.concatenate(places))

    return text_of(docs, "doc_id").mapInArrow(run, "gram long, node long, n int, at int")


# ---------------------------------------------------------------------------------------------- candidate pairs

def whole_groups(batches, key_columns: list[str]):
    """Column arrays of sorted batches, cut only between groups of equal keys."""
    held = None
    for rows in batches:
        if rows.num_rows == 0:
            continue
        table = pa.Table.from_batches([rows]) if held is None else pa.concat_tables([held, pa.Table.from_batches([rows])])
        change = np.zeros(table.num_rows, bool)
        for name in key_columns:
            v = table[name].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts) == 0:
            held = table
            continue
        yield table.slice(0, int(cuts[-1]))
        held = table.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held


def _columns(table: pa.Table):
    n = table.num_rows
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(n, BITMAP_BITS // 64)
    return table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["at"].to_numpy().astype(np.int64), bits


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return batch(["a", "b"], np.minimum(a, b), np.maximum(a, b))


def near_pairs(groups: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs across components at distances 1, 4, 16, ... within a group: a few for each row.

    Rows are in order of size in the first turn, which takes only clearly close pairs, and of a hash in the others."""
    share = 1.0 if turn else CLOSE

    def run(batches):
        for table in whole_groups(batches, ["gram", "salt"]):
            gram, salt, label = table["gram"].to_numpy(), table["salt"].to_numpy(), table["label"].to_numpy()
            node, n, at, bits = _columns(table)
            step = 1
            while step < len(node):
                i = np.flatnonzero((gram[:-step] == gram[step:]) & (salt[:-step] == salt[step:]))
                if len(i) == 0:
                    break
                i = i[label[i] != label[i + step]]
                j = i + step
                ok = passes(n[i], at[i], bits[i], n[j], at[j], bits[j], share)
                if ok.any():
                    yield _pairs(node[i[ok]], node[j[ok]])
                step *= 4

    salted = groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / GROUP_ROWS)).cast("int"))
    order = ["n", "node"] if turn == 0 else [F.xxhash64(F.lit(turn), "node"), "node"]
    dealt = salted.repartition("gram", "salt").sortWithinPartitions("gram", "salt", *order)
    return dealt.select("gram", "salt", "label", "node", "n", "at", "bits").mapInArrow(run, "a long, b long").distinct()


def pairs_across(groups: DataFrame) -> DataFrame:
    """All pairs of a group that pass the filters and lie in different components (column ``label``)."""
    def run(batches):
        for table in whole_groups(batches, ["gram", "salt"]):
            gram, salt, label, salts = (table[c].to_numpy() for c in ("gram", "salt", "label", "salts"))
            node, n, at, bits = _columns(table)
            mine = table["own"].to_numpy() == salt
            starts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])]))
            ends = np.append(starts[1:], len(gram))
            for lo, hi in zip(starts[np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)].tolist(),
                              ends[np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)].tolist()):
                kinds, which, sizes = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
                rest = lo + np.flatnonzero((which != np.argmax(sizes)) & mine[lo:hi])
                for block in np.array_split(rest, max(1, -(-len(rest) * (hi - lo) // (1 << 20)))):  # a million pairs at a time
                    i, j = np.repeat(block, hi - lo), np.tile(np.arange(lo, hi), len(block))
                    other = label[i] != label[j]
                    i, j = i[other], j[other]
                    ok = passes(n[i], at[i], bits[i], n[j], at[j], bits[j])
                    if ok.any():
                        yield _pairs(node[i[ok]], node[j[ok]])

    # a group of many rows goes to several tasks; each compares its own share with all rows
    spread = groups.withColumn("salts", F.ceil(F.col("rows") / GROUP_ROWS).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = spread.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return dealt.select("gram", "salt", "salts", "own", "node", "n", "at", "label", "bits").mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------------------------------------- verification

def sets_of(docs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(node, grams) of the named documents."""
    def run(batches):
        for rows in batches:
            for part, data, offsets in chunks(rows):
                yield batch(["node", "grams"], part.column(0), pa.array([s.tobytes() for s in gram_sets(data, offsets)], pa.binary()))

    chosen = text_of(docs, F.col("doc_id").cast("long").alias("node")).join(broadcast_if(nodes, rows), "node", "left_semi")
    return chosen.mapInArrow(run, "node long, grams binary").filter(F.length("grams") > 0)


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        if len(s) > len(t):
            s, t = t, s
        at = np.searchsorted(t, s)
        common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        out.append(100 * common >= PERCENT * (len(s) + len(t) - common))
    return pa.array(out, pa.bool_())


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, with ``linked``: stored, and each pair once."""
    nodes, rows = sized(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = store(sets_of(docs, nodes, rows))
    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", F.arrow_udf(_alike, "boolean")("grams_a", "grams_b").alias("linked"))
    return store(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")))


# ---------------------------------------------------------------------------------------------- the join

def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, representative) of every row; representatives are least ids of equal sets."""
    bits = sketch_bits(docs.count())
    profiled = store(profile(docs, bits))
    sketch = frequencies(profiled, bits)
    known = profiled.filter("slice is null").select("doc_id", "n", "digest", "bits")
    classes = store(known.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("node"), F.first("bits").alias("bits")))
    nodes, count = sized(classes.select("node").distinct())
    chosen = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).join(broadcast_if(nodes.select(F.col("node").alias("doc_id")), count), "doc_id", "left_semi")
    same = Window.partitionBy("gram")
    groups = store(prefixes(chosen, sketch, bits).withColumn("rows", F.count(F.lit(1)).over(same)).filter("rows > 1"))
    bitmaps = classes.select("node", "n", "bits")

    def mixed(labels: DataFrame | None) -> DataFrame:
        """Rows with their components, of groups that hold several, and with their bitmaps."""
        if labels is None:
            return groups.withColumn("label", F.col("node")).join(bitmaps, ["node", "n"])
        own = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        own = own.withColumns({"__least": F.min("label").over(same), "__most": F.max("label").over(same)}).filter("__least <> __most")
        return own.drop("__least", "__most").join(bitmaps, ["node", "n"])

    labels, tried, links = None, None, None
    for turn in range(1 + ROUNDS):
        candidates = near_pairs(mixed(labels), turn)
        if tried is not None:
            candidates = candidates.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        _, trees = forest(candidates, labels)
        if turn and not trees.limit(1).count():
            break
        checked = verified(docs, trees)
        tried = checked if tried is None else tried.unionByName(checked)
        links = tried.filter("linked").select("a", "b")
        labels = components(links)
    late = pairs_across(mixed(labels)).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(verified(docs, store(late)).filter("linked").select("a", "b"))

    found = components(links).select(F.col("node"), F.col("label").alias("component_id"))
    # documents of one class share its component; a doc_id with several texts joins their classes
    member = known.filter("n > 0 and doc_id is not null").join(classes.select("digest", "n", "node"), ["digest", "n"])
    several = member.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    ids = known.filter("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("digest", "n").alias("sets")).filter("sets > 1")
    if ids.limit(1).count():
        found = components(links.unionByName(several)).select(F.col("node"), F.col("label").alias("component_id"))
    member = member.select("digest", "n", "node").distinct().join(found, "node", "left") \
        .select("digest", "n", F.coalesce("component_id", "node").alias("component_id"), F.col("node").alias("representative"))
    out = known.join(member, ["digest", "n"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(~alone, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(~alone, F.col("representative")).otherwise(F.col("doc_id")).alias("representative"))


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return similar_groups(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one of least id (of several rows with that id, one)."""
    groups = store(similar_groups(docs).select(F.col("doc_id").alias("__id"), "component_id").filter("__id is not null"))
    kept, rows = sized(groups.filter("component_id = __id").select("__id").distinct())
    total, ids = groups.agg(F.count("__id"), F.count_distinct("__id")).first()
    # whole rows travel as one struct, so no column of theirs can clash
    whole = docs.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    named = whole.join(broadcast_if(kept, rows), "__id", "left_semi")
    if total > ids:
        named = named.dropDuplicates(["__id"])
    return named.select("__row").union(whole.filter("__id is null").select("__row")).select("__row.*")
