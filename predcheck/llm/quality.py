"""Document quality from a linear-chain conditional random field over lines.

Every non-empty line is good or bad. Its evidence is what it looks like (length, letters, digits, symbols, repeated
words and lines, ...) and what its neighbouring lines look like; neighbouring labels depend on each other. Forward and
backward passes run over many documents at once, step by step along their lines. A document's quality is the mean of
its lines' probabilities of being good, weighted by length, put on the scale of the labels by a logistic curve.

Training takes at most ``sample`` labelled documents (those of least hash; a bounded, documented sample); every line
of a document carries its document's label. Every text is scored whole.

Defined cases: a null text, an empty one or one of line breaks only scores the smoothed share of label 1; labels that
are null, or whose doc_id is null, are not learnt from; several labels of one document count as their largest; without
labels of both classes every text scores that share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import batch, held_out, text_of
from .text import NOT_SPACE, chunks, mix, word_hashes, word_spans
from .toxicity import FOLDS, HELD_OUT_FOLD, curve, sampled

SAMPLE = 6_000
CUT = 0.3

_B = np.arange(256)


def _is(characters: str) -> np.ndarray:
    return np.isin(_B, np.frombuffer(characters.encode(), np.uint8))


UPPER, LOWER_CASE, DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
#: Shares of a line's bytes.
CLASSES = (LOWER_CASE, UPPER, DIGIT, _B == 32, _B >= 128, _is("#$%&*@^~=+<>{}[]\\_/"), _is("|"), _is("!?"), _is(".,;:"), _is("-'\"()"))
N_OWN = len(CLASSES) + 16
N_FEATURES = 3 * N_OWN + 3


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first): non-empty lines of all texts; lines of text i are first[i]..first[i+1]."""
    return word_spans(data, offsets, _B != 10)


def line_features(data: np.ndarray, offsets: np.ndarray):
    """(features of every line, lengths, first): what each line and its neighbours look like."""
    starts, ends, first = lines_of(data, offsets)
    n, length = len(starts), ends - starts
    if n == 0:
        return np.zeros((0, N_FEATURES), np.float32), length, first
    bounds = np.stack([starts, ends], 1).ravel()
    codes = np.zeros(256, np.uint8)
    for i, c in enumerate(CLASSES):
        codes[c] = i + 1
    coded = np.append(codes[data], np.uint8(0))
    shares = [np.add.reduceat((coded == i + 1).view(np.uint8), bounds, dtype=np.int64)[::2] / length for i in range(len(CLASSES))]
    # words: number, length, distinctness, repeats of the word before, of the document and of whole lines
    ws, we, _ = word_spans(data, offsets, NOT_SPACE)
    words_first = np.searchsorted(ws, np.append(starts, len(data)))
    words_first[-1] = len(ws)
    n_words = np.maximum(np.diff(words_first), 0)
    line = np.repeat(np.arange(n), n_words)
    line_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = word_hashes(data, ws, we)
    per = np.maximum(n_words, 1)

    def mean(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line, flags, n) / per

    same = np.zeros(len(ws))
    if len(ws) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    in_doc = np.ones(len(ws))
    in_doc[np.unique(hashes ^ mix(line_doc[line].astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = 0
    in_line = np.ones(len(ws))
    in_line[np.unique(hashes ^ mix(line.astype(np.uint64) + np.uint64(1 << 40)), return_index=True)[1]] = 0
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, line, mix(hashes + (np.arange(len(hashes)) - words_first[:-1][line]).astype(np.uint64)))
    repeated_line = np.ones(n)
    repeated_line[np.unique(whole ^ mix(line_doc.astype(np.uint64) + np.uint64(7)), return_index=True)[1]] = 0
    word_length = np.bincount(line, (we - ws).astype(float), n) / per
    last, begin = data[ends - 1], data[starts]
    symbols, letters = shares[5], shares[0] + shares[1] + shares[4]
    upper = shares[1] / np.maximum(shares[0] + shares[1], 1e-9)
    own = np.stack([*shares, np.log1p(length) / 8, np.log1p(n_words) / 6, word_length / 10, mean(same), mean(in_doc), mean(in_line),
                    repeated_line, _is(".!?")[last].astype(float), UPPER[begin].astype(float), upper,
                    (symbols > 0.05).astype(float), (upper > 0.5).astype(float), (shares[6] > 0.02).astype(float), (shares[7] > 0.05).astype(float),
                    (mean(in_line) > 0.5).astype(float), (letters < 0.5).astype(float)], 1).astype(np.float32)
    lone = first[:-1][np.diff(first) > 0]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[lone] = True
    is_last[first[1:][np.diff(first) > 0] - 1] = True
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([own, before, after, np.ones((n, 1), np.float32), is_first[:, None], is_last[:, None]], 1).astype(np.float32), length, first


class Steps:
    """Lines of many documents in the order of their place in a document; longer documents first within a place."""

    def __init__(self, first: np.ndarray):
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        longest = int(counts.max(initial=0))
        self.active = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        place = np.arange(int(counts.sum())) - np.repeat(first[:-1], counts)
        self.at = self.offset[place] + np.repeat(rank, counts)  # where each line goes
        self.order, self.counts = order, counts


class Field(NamedTuple):
    """Evidence weights (good against bad), start and transition log-potentials, and the curve of documents."""
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    slope: float
    level: float
    prior: float

    def passes(self, features: np.ndarray, steps: Steps):
        """(P(good) of lines in step order, forward, potentials, backward, scales)."""
        e = np.empty(len(features))
        e[steps.at] = features @ self.weights.astype(np.float32)
        e = np.clip(e, -30, 30)
        pot = np.stack([np.ones_like(e), np.exp(e)], 1)
        pot /= pot.max(1, keepdims=True)
        a, b, scale = np.empty_like(pot), np.ones_like(pot), np.empty(len(e))
        move = np.exp(self.move)
        for t, n in enumerate(steps.active):
            here = slice(steps.offset[t], steps.offset[t] + n)
            back = slice(steps.offset[t - 1], steps.offset[t - 1] + n)
            x = pot[here] * (np.exp(self.start) if t == 0 else a[back] @ move)
            scale[here] = x.sum(1)
            a[here] = x / scale[here][:, None]
        for t in range(len(steps.active) - 1, 0, -1):
            n = steps.active[t]
            here = slice(steps.offset[t], steps.offset[t] + n)
            back = slice(steps.offset[t - 1], steps.offset[t - 1] + n)
            b[back] = (b[here] * pot[here] / scale[here][:, None]) @ move.T
        both = a * b
        return both[:, 1] / both.sum(1), a, pot, b, scale

    def lines(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        steps = Steps(first)
        return self.passes(features, steps)[0][steps.at]

    def documents(self, features: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(first)
        out = np.full(len(counts), self.prior)
        if len(self.weights) and len(features):
            share = weighted(self.lines(features, first), length, counts)
            z = self.slope * logit(share) + self.level
            out[counts > 0] = (1 / (1 + np.exp(-np.clip(z, -35, 35))))[counts > 0]
        return out


def weighted(p: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of lines' values by document, weighted by length; 0.5 without lines."""
    doc = np.repeat(np.arange(len(counts)), counts)
    size = np.bincount(doc, length, len(counts))
    return np.where(size > 0, np.bincount(doc, p * length, len(counts)) / np.maximum(size, 1), 0.5)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, length: np.ndarray, first: np.ndarray, labels: np.ndarray, l2: float = 1e-3, rounds: int = 200) -> Field:
    """Train on lines (grouped by ``first``) of documents with labels 0/1."""
    counts = np.diff(first)
    positive, n = float(labels.sum()), len(labels)
    prior = (positive + 1) / (n + 2)
    if positive in (0.0, float(n)) or len(features) == 0:
        return Field(np.zeros(0), np.zeros(2), np.zeros((2, 2)), 1.0, 0.0, prior)
    steps = Steps(first)
    y = np.repeat(labels, counts).astype(float)
    in_steps = np.empty(len(y), np.int64)
    in_steps[steps.at] = np.repeat(labels, counts)
    x = np.empty_like(features)
    x[steps.at] = features
    # a document's lines count by 1 / sqrt(their number), so long documents don't drown short ones
    doc_weight = 1 / np.sqrt(np.maximum(counts, 1))
    own = np.empty(len(y))
    own[steps.at] = np.repeat(doc_weight, counts)
    own /= own.sum()
    field = Field(np.zeros(features.shape[1]), np.zeros(2), np.zeros((2, 2)), 1.0, 0.0, prior)
    theta = np.zeros(features.shape[1] + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    later = np.arange(steps.offset[1], len(y))
    earlier = np.concatenate([np.arange(steps.offset[t - 1], steps.offset[t - 1] + steps.active[t]) for t in range(1, len(steps.active))]
                             or [np.zeros(0, np.int64)])
    for step in range(1, rounds + 1):
        field = field._replace(weights=theta[:-6], start=theta[-6:-4], move=theta[-4:].reshape(2, 2))
        p, a, pot, b, scale = field.passes(features, steps)
        g = np.zeros_like(theta)
        g[:-6] = x.T @ ((p - in_steps) * own).astype(np.float32) + l2 * theta[:-6]
        begin = slice(0, steps.active[0])
        surplus = (p[begin] - in_steps[begin]) * own[begin]
        g[-6:-4] = -surplus.sum(), surplus.sum()
        pair = a[earlier][:, :, None] * np.exp(field.move)[None] * (pot[later] * b[later] / scale[later][:, None])[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        expected = (pair * own[later][:, None, None]).sum(0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (in_steps[earlier], in_steps[later]), own[later])
        g[-4:] = (expected - seen).ravel() + 1e-2 * theta[-4:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) * min(1.0, 2 * (1 - step / (rounds + 1)))
    field = field._replace(weights=theta[:-6], start=theta[-6:-4], move=theta[-4:].reshape(2, 2))
    full = counts > 0
    slope, level = curve(logit(weighted(field.lines(features, first), length, counts))[full], labels[full])
    return field._replace(slope=slope, level=level)


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Field:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    joined = text_of(docs, "doc_id").join(F.broadcast(sampled(labels, target, sample)), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        for rows in batches:
            for part, data, offsets in chunks(rows):
                x, length, first = line_features(data, offsets)
                cut = [x[first[i]:first[i + 1]].astype(np.float16).tobytes() for i in range(len(first) - 1)]
                lengths = [length[first[i]:first[i + 1]].astype(np.int32).tobytes() for i in range(len(first) - 1)]
                yield batch(["doc_id", "label", "x", "length"], part.column(0), part.column(2), pa.array(cut, pa.binary()), pa.array(lengths, pa.binary()))

    table = joined.mapInArrow(run, "doc_id long, label int, x binary, length binary").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    y = table["label"].to_numpy()[order]
    lengths = [np.frombuffer(table["length"][int(i)].as_py(), np.int32) for i in order]
    x = [np.frombuffer(table["x"][int(i)].as_py(), np.float16).reshape(-1, N_FEATURES) for i in order]
    first = np.concatenate([[0], np.cumsum([len(v) for v in lengths])]).astype(np.int64)
    features = np.concatenate([*x, np.zeros((0, N_FEATURES), np.float16)]).astype(np.float32)
    return fit(features, np.concatenate([*lengths, np.zeros(0, np.int32)]), first, y)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score of every whole text."""
    def run(batches):
        for rows in batches:
            for part, data, offsets in chunks(rows):
                yield batch(["doc_id", "score"], part.column(0), field.documents(*line_features(data, offsets)))

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")


def line_marginals(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, line (from 0, empty lines not counted), length in bytes, and P(good) of every line."""
    def run(batches):
        for rows in batches:
            for part, data, offsets in chunks(rows):
                x, length, first = line_features(data, offsets)
                counts = np.diff(first)
                p = field.lines(x, first) if len(field.weights) and len(x) else np.full(len(x), field.prior)
                yield batch(["doc_id", "line", "length", "good"], part.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                            np.arange(len(x)) - np.repeat(first[:-1], counts), length, p)

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, line long, length long, good double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
