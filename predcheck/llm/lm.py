"""Language-model scores of documents: a causal self-attention model on subword ids, next to a word baseline.

Ids come from a public BPE vocabulary; a text ends with one end id. The model predicts an id's class from the ids
before it, by batched masked attention over overlapping windows that score each id once, and the id within its class by
corpus counts. The most frequent ids are classes of their own; the others share classes by frequency.

What is gathered from the corpus: the counts of all words of all training documents (hence of all subword ids), in one
shuffle of per-task counts; and the windows of all training documents, each used once. Attention weights are trained in
the tasks that hold the windows, block by block, and averaged between rounds. Texts are encoded once, into the classes
of their ids; training and scoring read those.

The baseline adds up logarithms of smoothed word frequencies. Frequent words, at most FREQUENT by definition of their
share, are looked up where a text is read; the others are shuffled by word, once, with one row per document.

Defined cases: a null or empty text is its end alone; documents that repeat an id, or have none, are scored like
others (a missing id is an empty text for the fold); without training documents the baseline and the model know
nothing and are uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import attention
from .subwords import default_path, word_ids
from .tables import batch, held_out, store, text_of
from .text import LOWER, chunks, word_hashes, word_spans

FOLDS, HELD_OUT_FOLD = 7, 2
#: A word is frequent if its share of all tokens is at least 1 / FREQUENT.
FREQUENT = 200_000
#: Every window of the training documents is used in one round.
ROUNDS, RATE = 4, 0.01
#: Ids whose windows a task holds together.
BLOCK_IDS = 400_000
#: Classes of all other ids together; END and the frequent ids are classes of their own.
SHARED = 24
SINGLE = attention.GROUPS * attention.MEMBERS - 1 - SHARED
VOCABULARY = 49_408
END = VOCABULARY  # and the input before the first id
_GROUPS = 64


def unique_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(hashes of the distinct words, one place of each, and which distinct word each word is)."""
    found = pa.array(word_hashes(data, starts, ends)).dictionary_encode()
    which = found.indices.to_numpy()
    place = np.empty(len(found.dictionary), np.int64)
    place[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return found.dictionary.to_numpy(), place, which


# ---------------------------------------------------------------------------------------------- corpus counts

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training documents, counted within tasks first."""
    def run(batches):
        counts: dict[bytes, int] = {}
        for rows in batches:
            for _, data, offsets in chunks(rows, "text"):
                data = LOWER[data]
                starts, ends, _ = word_spans(data, offsets)
                _, place, which = unique_words(data, starts, ends)
                raw = data.tobytes()
                for lo, hi, c in zip(starts[place].tolist(), ends[place].tolist(), np.bincount(which, minlength=len(place)).tolist()):
                    word = raw[lo:hi]
                    counts[word] = counts.get(word, 0) + c
                if len(counts) > 500_000:
                    yield batch(["word", "c"], pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()))
                    counts = {}
        if counts:
            yield batch(["word", "c"], pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()))

    learnt = text_of(docs, "doc_id").filter(~held_out("doc_id", FOLDS, HELD_OUT_FOLD))
    return learnt.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(words: DataFrame, path: str) -> np.ndarray:
    """Number of each subword id in all training documents: one number for each id of the vocabulary."""
    def run(batches):
        ids_of, counts = word_ids(path), np.zeros(VOCABULARY, np.int64)
        for rows in batches:
            lists = [ids_of[w] for w in rows.column(0).to_pylist()]
            ids = np.frombuffer(b"".join(lists), "<u4")
            np.add.at(counts, ids, np.repeat(rows.column(1).to_numpy(), [len(x) // 4 for x in lists]))
        used = np.flatnonzero(counts)
        if len(used):
            yield batch(["id", "c"], pa.array(used, pa.int64()), counts[used])

    out = np.zeros(VOCABULARY, np.int64)
    for row in words.mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[row["id"]] = row["c"]
    return out


def classes(counts: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each id, log10 share within the class, natural log share of each class) from smoothed counts."""
    smooth = np.append(counts, texts).astype(float) + 1
    order = np.argsort(-smooth[:VOCABULARY], kind="stable")
    class_of = np.empty(VOCABULARY + 1, np.int64)
    class_of[END] = 0
    class_of[order[:SINGLE]] = np.arange(1, SINGLE + 1)
    rest = order[SINGLE:]
    mass = np.cumsum(smooth[rest])
    class_of[rest] = SINGLE + 1 + np.minimum((mass * SHARED / mass[-1]).astype(np.int64), SHARED - 1)
    total = np.bincount(class_of, smooth, SINGLE + SHARED + 1)
    within = np.log10(smooth / total[class_of])
    return class_of, within, np.log(np.maximum(total, 1e-9) / total.sum())


class Encoded(NamedTuple):
    """A chunk of texts: entries are its distinct words, and END as the last one; ``order`` has each text's words and an END after them."""
    ids: np.ndarray  # of all entries, laid end to end
    sizes: np.ndarray
    order: np.ndarray
    n_words: np.ndarray
    hashes: np.ndarray  # of the distinct words
    which: np.ndarray  # of these each word is
    doc: np.ndarray  # number of the text of each word

    def first(self) -> np.ndarray:
        """Where each text begins in ``order``."""
        return np.cumsum(self.n_words + 1) - self.n_words - 1


def encoded(ids_of, data: np.ndarray, offsets: np.ndarray) -> Encoded:
    starts, ends, first = word_spans(data, offsets)
    hashes, place, which = unique_words(data, starts, ends)
    raw = data.tobytes()
    lists = [ids_of[raw[lo:hi]] for lo, hi in zip(starts[place].tolist(), ends[place].tolist())]
    ids = np.append(np.frombuffer(b"".join(lists), "<u4"), np.uint32(END))
    sizes = np.array([*map(len, lists), 4], np.int64) // 4
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    order = np.full(len(which) + len(n_words), len(lists), np.int32)
    order[np.arange(len(which)) + doc] = which
    return Encoded(ids, sizes, order, n_words, hashes, which, doc)


def texts_of(part: Encoded, codes: np.ndarray) -> pa.Array:
    """The ``codes`` of each text's ids, given those of ``part.ids``, as bytes."""
    ends = np.concatenate([[0], np.cumsum(part.sizes)]) * codes.itemsize
    entries = pa.Array.from_buffers(pa.large_binary(), len(part.sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])
    _, at, data = entries.take(pa.array(part.order)).buffers()
    borders = np.frombuffer(at, np.int64)[np.append(part.first(), len(part.order))]
    return pa.Array.from_buffers(pa.large_binary(), len(part.n_words), [None, pa.py_buffer(borders), data]).cast(pa.binary())


# ---------------------------------------------------------------------------------------------- training

def _pack(weights: dict) -> bytes:
    return b"".join(weights[k].tobytes() for k in sorted(weights))


def _unpack(raw: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def blocks(batches, begin: int, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, real) of the windows that round ``number`` takes, from batches of texts' codes, for BLOCK_IDS codes at a time.

    A text of more codes than that is cut into blocks."""
    def windows_of(texts):
        counts = np.array([len(x) for x in texts])
        targets = np.concatenate(texts)
        inputs = np.empty_like(targets)
        inputs[1:] = targets[:-1]
        inputs[np.cumsum(counts) - counts] = begin
        order = np.random.default_rng(11).permutation(int(attention.window_counts(counts).sum()))[number::ROUNDS]
        at, real, _ = attention.windows(counts, order)
        return np.where(real, inputs.take(at), np.uint16(0)), targets.take(at), real

    texts, size = [], 0
    for rows in batches:
        for raw in rows.column(0):
            codes = np.frombuffer(raw.as_py(), np.uint16)
            for i in range(0, len(codes), BLOCK_IDS):
                texts.append(codes[i:i + BLOCK_IDS])
                size += len(texts[-1])
                if size >= BLOCK_IDS:
                    yield windows_of(texts)
                    texts, size = [], 0
    if texts:
        yield windows_of(texts)


def train(coded: DataFrame, begin: int, log_shares: np.ndarray) -> dict:
    """Weights from all windows of the texts in ``codes``, by rounds of local training and averaging; ``begin`` is the class before the first id."""
    weights = attention.start(log_shares)
    for number in range(ROUNDS):
        raw = _pack(weights)

        def local(batches):
            seen = 0

            def counted():
                nonlocal seen
                for x, y, real in blocks(batches, begin, number):
                    seen += int(real.sum())
                    yield x, y, real

            own = attention.train(_unpack(raw, weights), counted(), RATE * 0.6 ** number)
            if seen:
                yield batch(["part", "n", "weights"], pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int32()), pa.array([float(seen)]), pa.array([_pack(own)], pa.binary()))

        def mean(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, size = 0.0, 0.0
            for rows in tables:
                for n, x in zip(rows.column("n").to_pylist(), rows.column("weights").to_pylist()):
                    total, size = total + n * np.frombuffer(x, np.float32).astype(float), size + n
            yield batch(["n", "weights"], pa.array([size]), pa.array([(total / size).astype(np.float32).tobytes()], pa.binary()))

        found = coded.mapInArrow(local, "part int, n double, weights binary").groupBy("part").applyInArrow(mean, "n double, weights binary").collect()
        if not found:  # no window fell to this round
            continue
        size = sum(r["n"] for r in found)
        average = sum(r["n"] / size * np.frombuffer(r["weights"], np.float32).astype(float) for r in found)
        weights = _unpack(average.astype(np.float32).tobytes(), weights)
    return weights


# ---------------------------------------------------------------------------------------------- scores

COLUMNS = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, codes binary, word long, n long"
SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def scores(coded: DataFrame, weights: dict, begin: int) -> DataFrame:
    """The rows of SCORED: ``inner`` and the model's log10 probability of the classes in ``codes``."""
    shared = coded.sparkSession.sparkContext.broadcast(weights)

    def of(codes: list) -> np.ndarray:
        counts = np.array([len(x) for x in codes])
        targets = np.concatenate(codes)
        inputs = np.empty_like(targets)
        inputs[1:] = targets[:-1]
        inputs[np.cumsum(counts) - counts] = begin  # a text has its END at least
        return np.bincount(np.repeat(np.arange(len(counts)), counts), attention.score(shared.value, inputs, targets, counts), len(counts)) / np.log(10)

    def run(batches):
        for rows in batches:
            out, held, size = [], [], 0
            for raw in rows.column("codes"):
                held.append(np.frombuffer(raw.as_py(), np.uint16))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    out.append(of(held))
                    held, size = [], 0
            if held:
                out.append(of(held))
            if out:
                names = [x.split()[0] for x in SCORED.split(", ")]
                yield batch(names, *(rows.column(c) for c in names[:-1]), np.concatenate(out) + rows.column("inner").to_numpy())

    return coded.mapInArrow(run, SCORED)


def lm_scores(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    path = tokenizer or default_path()
    words = store(word_counts(docs))
    n_words, distinct = words.agg(F.sum("c"), F.count("c")).first()
    texts = docs.filter(~held_out("doc_id", FOLDS, HELD_OUT_FOLD)).count()
    total, types = (n_words or 0) + texts, distinct + (texts > 0)
    common = words.filter(F.col("c") * FREQUENT >= total).toArrow()  # fewer than FREQUENT rows, as their shares add up to 1
    spellings = common["word"].to_pylist()
    ends = np.cumsum([len(w) for w in spellings]).astype(np.int64)
    hashes = word_hashes(np.frombuffer(b"".join(spellings), np.uint8), np.concatenate([[0], ends])[:-1].astype(np.int64), ends)
    order = np.argsort(hashes)
    counts = id_counts(words, path)
    class_of, within, log_shares = classes(counts, texts)
    begin = int(class_of[END])
    # bounded: numbers of the vocabulary's size, and fewer than FREQUENT words
    shared = spark.sparkContext.broadcast((class_of, within, hashes[order], common["c"].to_numpy()[order]))
    smooth = np.log10(total + types + 1)
    end_score = np.log10(texts + 1) - smooth

    def run(batches):
        classes_of, inside, frequent, c = shared.value
        ids_of, log_c, serial = word_ids(path), np.append(np.log10(c + 1.0), 0.0), TaskContext.get().partitionId() << 40
        frequent = np.append(frequent, np.uint64(2**64 - 1))
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        for rows in batches:
            for part, data, offsets in chunks(rows):
                found = encoded(ids_of, LOWER[data], offsets)
                unique, which, n_words, doc = found.hashes, found.which, found.n_words, found.doc
                of_entry = np.bincount(np.repeat(np.arange(len(found.sizes)), found.sizes), inside[found.ids], len(found.sizes))
                inner = np.add.reduceat(of_entry[found.order], found.first())  # a text has its END at least
                codes = texts_of(found, classes_of[found.ids].astype(np.uint16))
                at = np.searchsorted(frequent, unique)
                hit = (frequent[at] == unique) & (at < len(frequent) - 1)
                at[~hit] = len(frequent) - 1
                base = np.bincount(doc, log_c[at][which], len(n_words)) - n_words * smooth + end_score
                known = np.bincount(doc, hit[which], len(n_words)).astype(np.int64) + (texts > 0)
                rids = serial + np.arange(len(n_words))
                serial += len(n_words)
                none = pa.nulls(len(rids), pa.int64())
                yield batch(names, rids, part.column(0), part.column(2), n_words + 1, known, base, inner, codes, none, none)
                rare = ~hit[which] if len(which) else np.zeros(0, bool)
                pairs, n = np.unique(doc[rare] * max(1, len(unique)) + which[rare], return_counts=True)
                if len(pairs):
                    d, w = pairs // len(unique), pairs % len(unique)
                    empty = pa.nulls(len(pairs), pa.float64())
                    blank = pa.nulls(len(pairs), pa.int64())
                    yield batch(names, rids[d], blank, part.column(2).take(pa.array(d)), blank, blank, empty, empty, pa.nulls(len(pairs), pa.binary()), unique[w].astype(np.int64), n.astype(np.int64))

    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("held_out", held_out("doc_id", FOLDS, HELD_OUT_FOLD))
    stored = store(rows.select("doc_id", "text", "held_out").mapInArrow(run, COLUMNS))
    coded = stored.filter("word is null")
    weights = train(coded.filter("not held_out").select("codes"), begin, log_shares)
    rare = stored.filter("word is not null").select("word", "rid", "n", "held_out") \
        .withColumn("c", F.sum(F.when(~F.col("held_out"), F.col("n")).otherwise(0)).over(Window.partitionBy("word")))
    added = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = scores(coded.drop("word", "n"), weights, begin).join(added, "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
