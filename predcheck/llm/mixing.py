"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight (its share of all words) and a schedule (how its share moves over training time). The demand
for a source's words up to time t is the integral of its schedule; a document that starts at word c of its source's
stream is trained on when that demand reaches c. So documents get their positions by inverting the cumulative demand,
and one range sort by position gives the training order.

Within a source, documents follow a hash of id and text. A source with more demand than words is repeated in that
order, at most ``max_epochs`` times; the last document of the last pass may be taken in part, so that each source
meets its target to the word.

Prefix sums never bring a source into one task: hash ranges ("buckets") are summed first, offsets come from those
sums, and only a bucket's rows are ordered together. A hot source has as many buckets as any other.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; equal rows are taken like
different ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.align import dense_index
from .tables import store, text_of
from .text import count_words, strings, word_spans

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Per weight class, (time, relative weight) knots over [0, 1]: heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MIX_COLUMNS = ("mix_position", "mix_pass", "mix_words", "mix_key")
#: Documents of a bucket on average, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 512


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources given (source, source_size): shares of the total by weight, capped and reshared.

    The result adds ``class`` (place in ``weights``), ``weight`` and ``target``. A target is min(cap, level * weight);
    the level rises, one small aggregate a round, until the sources it caps no longer change.
    """
    ranked = dense_index(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    ranked = ranked.withColumn("class", (F.col("rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1))
    cap = F.col("source_size") * float(max_epochs)
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (weight or 1.0), -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        n, spent, free = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
                                    F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total - spent) / free, n
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))).drop("rank")


def invert(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches ``share`` of its total."""
    steps = list(zip(schedule, schedule[1:]))
    area = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in steps]
    before, out = 0.0, None
    for ((t0, w0), (t1, w1)), a in zip(steps, area):
        slope, left = (w1 - w0) / (t1 - t0), share * sum(area) - before
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0)))
        time = t0 + (2 * left / (w0 + root) if w0 or slope else F.lit(t1 - t0))
        time = F.greatest(F.lit(t0), F.least(F.lit(t1), time))
        reach = share * sum(area) <= before + a
        out = F.when(reach, time) if out is None else out.when(reach, time)
        before += a
    return out.otherwise(F.lit(schedule[-1][0]))


def plan(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS,
         schedules=SCHEDULES) -> DataFrame:
    """Per document: size, source_size, target, taken (words, repeats counted) and ``stream_start``, its first word's
    place in its source's stream. ``keep`` names further columns to carry."""
    rows = docs.select(*keep, F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text")).alias("__key"),
                       F.arrow_udf(count_words, "bigint")(F.col("text").cast("string")).alias("size"))
    # a null source as a key that joins and windows treat as a value of its own
    rows = rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    buckets = max(LEAST_BUCKETS, 1 << (docs.count() // BUCKET_ROWS).bit_length())
    place = F.shiftrightunsigned("__key", 33) * F.lit(buckets) / F.lit(float(1 << 31))
    rows = rows.withColumn("__bucket", F.floor(place).cast("int"))
    # read again for the documents: bucket sums are stored, a few numbers for each source and bucket
    sums = store(rows.groupBy("__source", "source", "__bucket").agg(F.sum("size").alias("__words")))
    sources = targets(sums.groupBy("__source", "source").agg(F.sum("__words").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("__source").orderBy("__bucket")
    spread = sums.select("__source", "__bucket", (F.sum("__words").over(earlier) - F.col("__words")).alias("__before")) \
        .join(sources.drop("source", "weight"), "__source")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(spread, ["__source", "__bucket"]) \
        .withColumn("stream_start", F.col("__before") + F.sum("size").over(inside) - F.col("size"))
    goal = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - passes * F.col("source_size")
    placed = placed.withColumns({"passes": passes, "part": F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("stream_start")))})
    share = F.when(F.col("target") > 0, F.col("stream_start") / F.col("target"))
    return placed.withColumns({"taken": F.col("passes") * F.col("size") + F.col("part"), "first_position": _position(share, schedules)}) \
        .drop("__before", "__bucket", "__source")


def _position(share: Column, schedules) -> Column:
    out = None
    for i, schedule in enumerate(schedules):
        test = F.col("class") % len(schedules) == i
        out = F.when(test, invert(share, schedule)) if out is None else out.when(test, invert(share, schedule))
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """The training order: a row per document and pass with ``position`` in [0, 1], ``pass`` and ``words`` taken,
    range-sorted by position. Columns of ``docs`` are kept; a part taken of a document is its first ``words`` words."""
    names = [c for c in docs.columns if c not in MIX_COLUMNS]  # columns of an earlier mix are replaced
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), "doc_id", "source", "text")
    rows = plan(kept, ["__doc"], weights, max_epochs, schedules)
    whole = F.transform(F.sequence(F.lit(0), F.col("passes").cast("int")), lambda i: F.struct(
        i.alias("pass"), F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words")))
    rows = rows.withColumn("__copy", F.explode(F.filter(whole, lambda c: c["words"] > 0)))
    share = F.when(F.col("target") > 0, (F.col("stream_start") + F.col("__copy.pass") * F.col("source_size")) / F.col("target"))
    rows = rows.withColumn("position", _position(share, schedules))
    partial = F.col("__copy.words") < F.col("size")
    # only the text of a document taken in part goes through Python
    shorter = F.arrow_udf(first_words, "string")(F.when(partial, F.col("__doc.text")), F.col("__copy.words"))
    cut = F.when(partial, shorter).otherwise(F.col("__doc.text"))
    out = rows.select(*[cut.alias(c) if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in names],
                      F.col("position").alias("mix_position"), F.col("__copy.pass").alias("mix_pass"),
                      F.col("__copy.words").alias("mix_words"), F.col("__key").alias("mix_key"))
    return out.repartitionByRange("mix_position", "mix_key").sortWithinPartitions("mix_position", "mix_key").drop("mix_key")


def first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """Each text up to the end of its n-th word; null for a null."""
    data, offsets = strings(texts)
    out = []
    for i, (text, n) in enumerate(zip(texts, counts.to_pylist())):
        if not text.is_valid or n is None:
            out.append(None)
            continue
        own = data[offsets[i]:offsets[i + 1]]
        _, ends, _ = word_spans(own, np.array([0, len(own)]))
        out.append(own[:ends[min(n, len(ends)) - 1] if n and len(ends) else 0].tobytes().decode())
    return pa.array(out, pa.string())


def curriculum_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position."""
    return plan(text_of(docs, "doc_id", "source")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_position")
