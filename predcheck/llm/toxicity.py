"""A counterfactually regularised toxicity classifier.

A logistic regression over the presence of words. For every labelled text with identity terms, a counterfactual text
has each of them swapped for another term of its group; training penalises the squared change of the score's log-odds
between the two. A word that only names a group thus cannot carry a score of its own, and neutral mentions of a group
don't become toxic.

Training takes at most ``sample`` labelled documents (those of least hash; a bounded, documented sample). Words that
fewer than ``least_docs`` of them contain, or that don't separate the labels beyond chance, are not features; the
``features`` that separate best are kept, identity terms always. Every text is scored whole.

Defined cases: a null or empty text scores the model's intercept; labels that are null, or whose doc_id is null, are
not learnt from; several labels of one document count as their largest; a document without a label is scored only;
without any label, or with one class, the score is that class's smoothed share for every text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import batch, held_out, text_of
from .text import ALNUM, LOWER, chunks, word_hashes, word_spans

FOLDS, HELD_OUT_FOLD = 5, 0
SAMPLE = 10_000
FEATURES, LEAST_DOCS = 3_000, 3
#: Standard deviations that a word's share of label 1 must be off the overall share.
SEPARATION = 2.6
CUT = 0.5

#: Groups of terms that may stand for each other in a counterfactual sentence; within a group, each is swapped for the next.
IDENTITY_GROUPS = (
    "he she they", "him her them", "his hers theirs", "man woman person", "men women people", "male female nonbinary", "boy girl child",
    "boys girls children", "father mother parent", "husband wife spouse", "son daughter kid", "brother sister sibling", "mr mrs ms",
    "muslim christian jewish hindu buddhist sikh atheist catholic protestant", "muslims christians jews hindus buddhists sikhs atheists catholics protestants",
    "islam christianity judaism hinduism buddhism atheism", "mosque church synagogue temple",
    "black white asian latino hispanic arab indigenous african european", "blacks whites asians latinos hispanics arabs africans europeans",
    "american mexican chinese indian german french spanish russian turkish polish nigerian iranian",
    "americans mexicans indians germans russians turks poles nigerians iranians", "gay straight lesbian bisexual queer heterosexual homosexual", "gays lesbians bisexuals heterosexuals homosexuals",
    "transgender cisgender trans cis", "young old elderly teenage", "blind deaf disabled paralyzed autistic", "immigrant refugee citizen migrant native",
    "immigrants refugees citizens migrants natives", "rich poor", "liberal conservative", "liberals conservatives",
    "homme femme", "hommes femmes", "musulman chrétien juif", "noir blanc", "mann frau", "männer frauen", "moslem christ jude", "hombre mujer", "hombres mujeres", "musulmán cristiano judío",
)


def hash_of(words) -> np.ndarray:
    """Hashes of words given as strings, as texts give them."""
    raw = [LOWER[np.frombuffer(w.encode(), np.uint8)] for w in words]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    data = np.concatenate([*raw, np.zeros(0, np.uint8)])
    return word_hashes(data, np.concatenate([[0], ends])[:-1].astype(np.int64), ends)


def swaps() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of identity terms, and of the terms they are swapped for."""
    terms = [(w, group[(i + 1) % len(group)]) for group in (g.split() for g in IDENTITY_GROUPS) for i, w in enumerate(group)]
    return hash_of([a for a, _ in terms]), hash_of([b for _, b in terms])


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words by text)."""
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return word_hashes(LOWER[data], starts, ends), np.diff(first)


class Model(NamedTuple):
    """Sorted word hashes with weights, and the intercept."""
    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(counts)), counts)
        z = np.full(len(counts), self.intercept)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            pairs = np.unique(doc[hit] * len(self.words) + at[hit])  # presence, not counts
            z += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], len(counts))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(doc: np.ndarray, words: np.ndarray, labels: np.ndarray, features: int = FEATURES, least_docs: int = LEAST_DOCS,
        l2: float = 1e-5, fairness: float = 1.0, rounds: int = 500) -> Model:
    """Train on distinct (doc, word) pairs: doc numbers 0..len(labels)-1, word hashes, labels 0/1."""
    n, positive = len(labels), float(labels.sum())
    prior = np.log((positive + 0.5) / (n - positive + 0.5))
    if n == 0 or positive in (0.0, float(n)) or len(words) == 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(prior))
    identity, swapped = swaps()
    known, index = np.unique(words, return_inverse=True)
    in_all, in_toxic = np.bincount(index), np.bincount(index, labels[doc])
    # how far the share of label 1 among a word's documents is from the overall share, in standard deviations
    share = positive / n
    gap = np.abs(in_toxic - in_all * share) / np.sqrt(in_all * share * (1 - share) + 1)
    gap[in_all < least_docs] = -1
    gap[np.isin(known, identity)] = np.inf
    kept = np.sort(np.argsort(-gap, kind="stable")[:max(features, int(np.isinf(gap).sum()))])
    kept = kept[gap[kept] >= SEPARATION]
    if len(kept) == 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(prior))
    column = np.full(len(known), -1)
    column[kept] = np.arange(len(kept))
    used = column[index] >= 0
    rows, cols = doc[used], column[index[used]]
    # counterfactual rows: what a swap adds and removes; terms outside the features have no weight to change
    where = np.searchsorted(known[kept], identity)
    where = np.where((where < len(kept)) & (known[kept][np.minimum(where, len(kept) - 1)] == identity), where, -1)
    to = np.searchsorted(known[kept], swapped)
    to = np.where((to < len(kept)) & (known[kept][np.minimum(to, len(kept) - 1)] == swapped), to, -1)
    target = np.full(len(kept), -2)
    target[where[where >= 0]] = to[where >= 0]
    named = target[cols] > -2
    swap_rows = np.concatenate([rows[named], rows[named][target[cols[named]] >= 0]])
    swap_cols = np.concatenate([cols[named], target[cols[named]][target[cols[named]] >= 0]])
    swap_sign = np.concatenate([np.ones(int(named.sum())), -np.ones(int((target[cols[named]] >= 0).sum()))])

    w, b, y = np.zeros(len(kept)), float(prior), labels.astype(float)
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], n), -35, 35)))
        slope = (p - y) / n
        change = np.bincount(swap_rows, swap_sign * w[swap_cols], n)
        g = np.bincount(cols, slope[rows], len(kept)) + l2 * w
        g += 2 * fairness / n * np.bincount(swap_cols, swap_sign * change[swap_rows], len(kept))
        g = np.append(g, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) * min(1.0, 2 * (1 - step / (rounds + 1)))
        w, b = w - move[:-1], b - move[-1]
    scale, shift = curve(b + np.bincount(rows, w[cols], n), y)
    return Model(known[kept], scale * w, float(scale * b + shift))


def curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on one number, by Newton's steps with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def sampled(labels: DataFrame, target: str, sample: int) -> DataFrame:
    """(doc_id, label) of at most ``sample`` labelled documents outside the held-out fold, those of least hash."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out("doc_id", FOLDS, HELD_OUT_FOLD)) \
        .groupBy("doc_id").agg((F.max(target) > 0).cast("int").alias("label"))
    order = F.xxhash64(F.lit(3), "doc_id")
    # only about the wanted number of rows reaches the final ordering, however many labels there are
    share = min(1.0, 1.3 * sample / max(1, marks.count()))
    return marks.filter(F.pmod(order, F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.pmod(order, F.lit(1 << 20)), order, "doc_id").limit(sample)


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    chosen = sampled(labels, target, sample)
    joined = text_of(docs, "doc_id").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        for rows in batches:
            for part, data, offsets in chunks(rows):
                hashes, counts = text_hashes(data, offsets)
                at = np.concatenate([[0], np.cumsum(counts)])
                sets = [np.unique(hashes[at[i]:at[i + 1]]).tobytes() for i in range(len(counts))]
                yield batch(["doc_id", "label", "words"], part.column(0), part.column(2), pa.array(sets, pa.binary()))

    table = joined.mapInArrow(run, "doc_id long, label int, words binary").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    sets = [np.frombuffer(s, np.uint64) for s in table["words"].to_pylist()]
    sets = [sets[i] for i in order]
    y = table["label"].to_numpy()[order]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return fit(doc, np.concatenate([*sets, np.zeros(0, np.uint64)]), y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    def run(batches):
        for rows in batches:
            for part, data, offsets in chunks(rows):
                yield batch(["doc_id", "score"], part.column(0), model.scores(*text_hashes(data, offsets)))

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")


def scorer(model: Model):
    """The same score as a column function of the text, for use beside other columns."""
    def run(texts: pa.Array) -> pa.Array:
        rows = pa.record_batch([texts], names=["text"])
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(*text_hashes(data, offsets)) for _, data, offsets in chunks(rows))]))

    return F.arrow_udf(run, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
