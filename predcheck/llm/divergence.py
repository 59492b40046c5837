"""How far the vocabularies of a language's sources lie apart, by Gustavson row accumulation in whole numbers.

A group is a (lang, source). Its smoothed share p of a term follows from its count alone, so with p0, the share of a term that a group does not have,

    sum over all kept terms of f(pg, ph)  =  V f(p0g, p0h)
        + sum over the terms of g of [f(pg, p0h) - f(p0g, p0h)]  +  the same with g and h changed over
        + sum over the terms that both have of [f(pg, ph) - f(pg, p0h) - f(p0g, ph) + f(p0g, p0h)].

The second line needs no other group's terms: the distinct counts of g meet the vector of p0 of its peers. The third is the product of the
group-by-term matrix with its transpose: the terms are dealt out in blocks, each task holds the term-major index of its block, and each group scatters
its terms' postings into one dense accumulator over its peers. Sums of a block leave the task, pairs of postings never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import batch, broadcast_if, sized, store
from .text import LOWER, chunks, word_spans

#: Fixed values of the report: scale and prior of a share, documents that a kept term is in, ranks of the term part.
SCALE, PRIOR, MIN_DOCS, TOP = 1_000_000_000, 2, 10, 10
#: Bytes of text that are counted at a time, postings of a block, and numbers of one step; none changes a result.
COUNT_BYTES, BLOCK, STEP = 1 << 23, 100_000, 1 << 20

_BYTES = np.arange(256)
#: Terms of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: ASCII letters and everything beyond ASCII.
LETTERS = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _codes(values: np.ndarray, weights: np.ndarray | None = None):
    """Distinct numbers, how often each occurs, and the sum of its weights."""
    if weights is None:
        return *np.unique(values, return_counts=True), None
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at], np.diff(np.append(at, len(ordered))), np.add.reduceat(weights[order], at) if len(at) else weights


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each chunk of texts, and one row without a term for each group in it."""
    for b in batches:
        for part, data, offsets in chunks(b, limit=COUNT_BYTES):
            inside = LETTERS[data]
            starts, ends, first = word_spans(data, offsets, LETTERS)
            at = np.concatenate([[0], np.cumsum(ends - starts)])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
            codes, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
            names = [part.column(i).dictionary_encode() for i in (0, 1)]
            lang, source = (n.indices.to_numpy().astype(np.int64) for n in names)
            sources = len(names[1].dictionary)
            group = lang * sources + source
            doc = np.repeat(np.arange(len(group)), np.diff(first))
            in_doc, times, _ = _codes(doc * size + codes)
            keys, docs, n = _codes(group[in_doc // size] * size + in_doc % size, times)
            seen = np.unique(group)
            of = np.concatenate([keys // size, seen])
            terms = pa.concat_arrays([words.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.nulls(len(seen), pa.string())])
            none = np.zeros(len(seen), np.int64)
            yield batch(("lang", "source", "term", "n", "docs"), names[0].dictionary.take(pa.array(of // sources)), names[1].dictionary.take(pa.array(of % sources)),
                        terms, np.concatenate([n, none]).astype(np.int64), np.concatenate([docs, none]).astype(np.int64))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared(key, rows):
    """Corrections of all pairs of groups for the terms of one block that both have: (lang, i, j, value) with i < j."""
    term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    g, p, p0 = (rows.column(c).to_numpy() for c in ("g", "p", "p0"))
    index = np.lexsort((g, term))  # the term-major index: postings of a term, its groups in order
    term, g, p, p0 = term[index], g[index], p[index], p0[index]
    end = np.searchsorted(term, term, side="right")
    row_of = np.argsort(g, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], g[row_of][1:] != g[row_of][:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    total = np.zeros(int(g.max(initial=-1)) + 1, np.int64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        mine = row_of[a:b]
        later = end[mine] - mine - 1  # postings of groups after this one
        steps = np.searchsorted(np.cumsum(later), np.arange(STEP, int(later.sum()) + STEP, STEP))
        lo = 0
        for hi in [*(steps[:-1] + 1), len(mine)]:
            n = later[lo:hi]
            own = np.repeat(mine[lo:hi], n)
            peer = own + 1 + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            x, x0, y, y0 = p[own], p0[own], p[peer], p0[peer]
            np.add.at(total, g[peer], distance(x, y) - distance(x, y0) - distance(x0, y) + distance(x0, y0))
            lo = hi
        met = np.flatnonzero(total)
        out.append((np.full(len(met), g[mine[0]]), met, total[met]))
        total[met] = 0
    i, j, value = (np.concatenate([o[c] for o in out] or [np.zeros(0, np.int64)]) for c in range(3))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "i": i, "j": j, "value": value})


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group and each peer of its language: what the group's terms add to the baseline, and once a pair the baseline itself."""
    for b in batches:
        for row in b.to_pylist():
            g, v, peers = row["g"], row["v"], np.array(row["peers"], np.int64)
            value = np.zeros(len(peers), np.int64)
            if v:
                own, share = np.int64(row["p0"]), np.array([x["p"] for x in row["shares"]], np.int64)
                times = np.array([x["times"] for x in row["shares"]], np.int64)
                base = distance(own, peers)
                value = np.where(np.arange(len(peers)) > g, v * base, 0) - times.sum() * base
                step = max(1, STEP // len(peers))
                for lo in range(0, len(share), step):
                    value += (times[lo:lo + step, None] * distance(share[lo:lo + step, None], peers)).sum(axis=0)
            h = np.delete(np.arange(len(peers)), g)
            if len(h):
                yield batch(("lang", "i", "j", "value"), pa.array([row["lang"]] * len(h), pa.string()), np.minimum(g, h), np.maximum(g, h), value[h])


def _share(n: str, total: str):
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)), exactly."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(18, 0)) * CAST({n} + {PRIOR} AS DECIMAL(19, 0))) div CAST({total} + {PRIOR} * v AS DECIMAL(19, 0))")


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks the other sources of the language by the summed distance
    f = floor((p-q)^2 / (p+q)) of shares, part ``term`` the TOP terms that a group has more of than its language.

    Null text, lang and source are empty strings, so a null and an empty source are one group; a repeated row is a further document. A language without kept terms has
    distance 0 between its sources and no terms; a source alone in its language has no pairs. Ties are ranked by the UTF-8 bytes of the item. Texts have no bound,
    an empty table gives an empty result, further columns of any name are ignored. Numbers are exact while counts stay below 2**62.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = store(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    kept, rows = sized(counts.filter("term IS NOT NULL").withColumns({"all_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "lead": F.min("source").over(term) == F.col("source")})
                       .filter(F.col("all_docs") >= MIN_DOCS).select("lang", "source", "term", "n", "total", "lead"))
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("v", "lang_total", "own_total")}
    groups, number = sized(counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(numbers)
                           .withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "p0": F.when(F.col("v") > 0, _share("0", "own_total"))}))
    postings = kept.join(broadcast_if(groups, number), ["lang", "source"]).withColumn("p", _share("n", "own_total"))

    more = postings.withColumn("q", _share("total", "lang_total")).filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    block = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-rows // BLOCK))))
    shared = postings.select("lang", block.alias("block"), "term", "g", "p", "p0").groupBy("lang", "block").applyInArrow(_shared, "lang string, i long, j long, value long")
    shares = postings.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("times")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "times")).alias("shares"))
    peers = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", F.coalesce("p0", F.lit(0)).alias("p0")))), lambda x: x["p0"]).alias("peers"))
    alone = groups.join(shares, ["lang", "g"], "left").join(peers, "lang").select("lang", "g", "v", "p0", F.coalesce("shares", F.array().cast("array<struct<p:bigint,times:bigint>>")).alias("shares"), "peers")
    apart = alone.mapInArrow(_baselines, "lang string, i long, j long, value long")
    pairs = apart.unionByName(shared).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("i").alias("g"), F.col("j").alias("h")), F.struct(F.col("j").alias("g"), F.col("i").alias("h")))).alias("x")).select("lang", "value", "x.g", "x.h")
    names = broadcast_if(groups.select("lang", "g", "source"), number)
    items = broadcast_if(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), number)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    others = both.join(names, ["lang", "g"]).join(items, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    return others.unionByName(terms)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS (SELECT f.*, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + {PRIOR} * v) AS p,
             sum(n) OVER (PARTITION BY lang, term) AS total, sum(n) OVER (PARTITION BY lang) AS all_total, v FROM f JOIN v USING (lang)),
q AS (SELECT *, 1 + ({SCALE}::HUGEINT * (total + {PRIOR})) // (all_total + {PRIOR} * v) AS q FROM p),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM q WHERE n > 0 AND p > q),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM t))
WHERE part = 'pair' OR rank <= {TOP}
"""
