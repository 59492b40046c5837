"""Exact quantiles of every group, for the nine usual definitions (Hyndman & Fan 1996).

A group that one task can sort is ranked with a window. A larger group is never sorted whole: approximate
split points cut it into value ranges, the ranges are counted with map-side aggregation, and only the ranges
that hold a wanted rank are shuffled and sorted. Ties at a split point form a range of their own, which needs
no sort at all, so one very frequent value cannot fill a task.

Groups that repeat the same design many times (the replicates of a bin) allow more: a few of them show where the
quantiles of all of them lie, and values outside those brackets only have to be counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.storage import compact, group_sizes, materialize, small, split_rows
from .breaks import passed
from .values import null_safe_join, quoted

# Plotting-position constants (a, b) of the continuous definitions 4 to 9.
PLOTTING = {4: (0.0, 1.0), 5: (0.5, 0.5), 6: (0.0, 0.0), 7: (1.0, 1.0), 8: (1 / 3, 1 / 3), 9: (0.375, 0.375)}
# Fixed value: tolerance added before rounding down, four times the double precision epsilon.
FUZZ = 4 * 2.0 ** -52

MAX_SPLITS = 256


def ranks(n: str, p: float | str, qtype: int = 7) -> tuple[str, str, str]:
    """SQL for the lower rank, the upper rank (both within 1..n) and the weight of the upper one; ``p`` may be SQL."""
    if not isinstance(p, str):
        if not 0 <= p <= 1:
            raise ValueError("probabilities must lie in [0, 1]")
        p = f"{float(p)!r}D"
    if qtype == 7:
        h = f"(({n} - 1) * {p} + 1)"
        j = f"floor({h})"
        weight = f"({h} - {j})"
    elif qtype in PLOTTING:
        a, b = PLOTTING[qtype]
        h = f"({a!r}D + {p} * ({n} + {1 - a - b!r}D))"
        j = f"floor({h} + {FUZZ!r}D)"
        weight = f"if(abs({h} - {j}) < {FUZZ!r}D, 0D, {h} - {j})"
    elif qtype in (1, 2, 3):
        h = f"({n} * {p} - {0.5 if qtype == 3 else 0.0}D)"
        j = f"floor({h} + {FUZZ!r}D)"
        weight = {1: f"if({h} > {j}, 1D, 0D)", 2: f"if({h} > {j}, 1D, 0.5D)",
                  3: f"if({h} != {j} or abs({j}) % 2 = 1, 1D, 0D)"}[qtype]
    else:
        raise ValueError(f"unknown quantile type: {qtype}")
    return f"greatest(1L, least({n}, {j}))", f"greatest(1L, least({n}, {j} + 1))", weight


def interpolate(lower: str, upper: str, weight: str) -> str:
    """SQL for a weighted mean that leaves equal or fully weighted values untouched (safe for infinities)."""
    return (f"case when {weight} = 0 or {lower} = {upper} then {lower} when {weight} = 1 then {upper} "
            f"else nanvl((1 - {weight}) * {lower} + {weight} * {upper}, null) end")


def _windowed(df, keys, value, probs, qtype, extra):
    by = ", ".join(quoted(k) for k in keys)
    v = quoted(value)
    spec = f"({f'partition by {by} ' if keys else ''}order by {v} asc nulls last"
    ranked = df.selectExpr(
        "*", f"row_number() over {spec}) as __rn", f"lead({v}) over {spec}) as __next",
        f"count({v}) over {spec} rows between unbounded preceding and unbounded following) as __n")
    picks = []
    for i, p in enumerate(probs):
        lo, hi, weight = ranks("__n", p, qtype)
        # One row of the group holds the lower rank; the row after it holds the upper one.
        upper = f"if({hi} > {lo}, __next, {v})"
        picks.append(F.expr(f"max(case when __rn = {lo} then {interpolate(v, upper, weight)} end) as __q{i}"))
    out = ranked.groupBy(*keys).agg(F.expr("max(__n) as n"), *picks, *extra)
    kept = [quoted(c) for c in out.columns if not c.startswith("__q")]
    return out.selectExpr(*kept, f"array({', '.join(f'__q{i}' for i in range(len(probs)))}) as q")


def select_ranks(df: DataFrame, keys: list[str], value: str, wants: DataFrame, largest: int,
                 split_keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``wants`` holds (keys, ``r``); the result adds ``v``, the r-th smallest non-null value of the group.

    ``largest`` bounds the rows of a group. ``df`` should be a stored table: it is scanned several times. Split
    points are computed per ``split_keys``, a subset of the keys whose groups share a similar distribution.
    """
    limit = limit or split_rows(df.sparkSession)
    split_keys = keys if split_keys is None else split_keys
    data = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if largest <= limit:
        w = Window.partitionBy(*keys).orderBy(value)
        ranked = data.select(*keys, F.col(value).alias("v"), F.row_number().over(w).cast("long").alias("r"))
        return null_safe_join(wants.select(*keys, "r"), ranked, [*keys, "r"], "inner").select(*keys, "r", "v")

    pieces = min(MAX_SPLITS, 2 * math.ceil(largest / limit))
    points = F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 20 * pieces)
    splits = materialize(data.groupBy(*split_keys).agg(F.array_sort(F.array_distinct(points)).alias("__s")))
    tagged = null_safe_join(data, small(splits, splits.count(), 64 + 8 * pieces), split_keys, "inner")
    below = F.size(F.filter("__s", lambda s: s < F.col(value)))
    at = F.array_contains("__s", F.col(value)).cast("int")
    tagged = tagged.withColumn("__part", 2 * below + at).drop("__s")
    parts = materialize(tagged.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max")))
    # At most 2 * MAX_SPLITS ranges per group.
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    spans = parts.withColumn("__before", before)
    joined = null_safe_join(spans, wants.select(*keys, "r"), keys, "inner")
    hits = materialize(joined.filter("r > __before and r <= __before + __n"))
    found = hits.filter("__min = __max").select(*keys, "r", F.col("__min").alias("v"))
    rest = hits.filter("__min != __max")
    left = rest.agg(F.max("__n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    if not left["c"]:
        return found
    name = f"__part{sum(k.startswith('__part') for k in keys)}"
    rest = rest.withColumnRenamed("__part", name)
    inner_keys = [*keys, name]
    sub = null_safe_join(tagged.withColumnRenamed("__part", name), small(rest.select(*inner_keys).distinct(), left["c"]),
                         inner_keys, "left_semi")
    local = rest.select(*inner_keys, F.col("r").alias("__r"), F.expr("r - __before").alias("r"))
    inner = select_ranks(sub, inner_keys, value, local.drop("__r"), left["n"], [*split_keys, name], limit)
    deep = null_safe_join(local, inner, [*inner_keys, "r"], "inner")
    return found.unionByName(deep.select(*keys, F.col("__r").alias("r"), "v"))


def _from_ranks(joined: DataFrame, probs: Sequence[float], qtype: int, kept: Sequence[str]) -> DataFrame:
    """The kept columns and ``q`` from ``n`` and ``__m``, a map from wanted ranks to values."""
    qs = []
    for i, p in enumerate(probs):
        lo, hi, weight = ranks("n", p, qtype)
        joined = joined.selectExpr("*", f"if(n > 0, cast(try_element_at(__m, {lo}) as double), null) as __lo{i}",
                                   f"if(n > 0, cast(try_element_at(__m, {hi}) as double), null) as __hi{i}")
        qs.append(interpolate(f"__lo{i}", f"__hi{i}", weight))
    return joined.selectExpr(*map(quoted, kept), f"array({', '.join(qs)}) as q")


def _split(df, keys, value, probs, qtype, extra, split_keys, limit):
    data = materialize(df)
    counted = data.groupBy(*keys).agg(F.count(value).alias("n"), F.count(F.lit(1)).alias("__rows"), *extra)
    hot = materialize(counted.filter(F.col("__rows") > limit))
    most, groups = hot.agg(F.max("__rows"), F.count(F.lit(1))).first()
    if not groups:
        return _windowed(data, keys, value, probs, qtype, extra)
    if keys:
        hot_keys = small(hot.select(*keys), groups)
        cold = _windowed(null_safe_join(data, hot_keys, keys, "left_anti"), keys, value, probs, qtype, extra)
        data = null_safe_join(data, hot_keys, keys, "left_semi")
    wanted = ", ".join(r for p in probs for r in ranks("n", p, qtype)[:2])
    wants = hot.filter("n > 0").selectExpr(*map(quoted, keys), f"explode(array_distinct(array({wanted}))) as r")
    found = select_ranks(data, keys, value, wants, most, split_keys, limit)
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("__m"))
    out = _from_ranks(null_safe_join(hot, found, keys, "left"), probs, qtype, [c for c in hot.columns if c != "__rows"])
    return cold.unionByName(out) if keys else out


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], qtype: int = 7,
                      extra: Sequence[Column] = (), largest: int | None = None,
                      split_keys: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """One row per group: keys, ``n`` (non-null values), the ``extra`` aggregates and ``q``, an array<double>.

    ``largest`` is an upper bound for the rows of a group when the caller knows one; it is counted otherwise. Groups of
    more than ``limit`` rows (``predcheck.splitRows``) are cut into ranges of values; the result is the same.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    limit = limit or split_rows(df.sparkSession)
    if largest is None:
        largest = group_sizes(df, keys)[1]
    if largest <= limit:
        return _windowed(df, keys, value, probs, qtype, list(extra))
    return _split(df, keys, value, probs, qtype, list(extra), list(split_keys) if split_keys is not None else keys, limit)


def steps_within_groups(df: DataFrame, keys: Sequence[str], value: str, sizes: DataFrame, closed: bool, qtype: int, largest: int) -> DataFrame:
    """(keys, ``q``): quantiles at i/k for every group's own k, from ``sizes`` (keys, k, n); the ends too if ``closed`` or k is 1.

    The ranks wanted are rows of a table, so the plan does not grow with the number of different k."""
    keys = list(keys)
    first = F.when(F.lit(closed) | (F.col("k") == 1), 0).otherwise(1)
    wanted = sizes.filter("n > 0").select(*keys, "k", F.col("n").cast("long").alias("n"), F.explode(F.sequence(first, F.col("k") - first)).alias("i"))
    lo, hi, weight = ranks("n", "(i / k)", qtype)
    wanted = materialize(wanted.selectExpr(*map(quoted, keys), "i", f"cast({lo} as long) as __lo", f"cast({hi} as long) as __hi", f"cast({weight} as double) as __w"))
    places = wanted.select(*keys, F.col("__lo").alias("r")).union(wanted.select(*keys, "__hi")).distinct()
    found = materialize(select_ranks(materialize(df.select(*keys, value)), keys, value, places, largest))
    for end in ("lo", "hi"):
        own = found.select(*keys, F.col("r").alias(f"__{end}"), F.col("v").cast("double").alias(f"__v{end}"))
        wanted = null_safe_join(wanted, own, [*keys, f"__{end}"], "inner")
    point = F.struct("i", F.expr(interpolate("__vlo", "__vhi", "__w")).alias("v"))
    return wanted.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("__p")).select(*keys, F.col("__p.v").alias("q"))


#: Replicates that show where the quantiles lie; with fewer than ten times as many, brackets do not pay.
PILOTS = 20
#: Expected share of the values inside the brackets above which they do not pay.
BRACKET_SHARE = 0.5


def brackets_pay(rows: int, replicates: int, probs: Sequence[float]) -> bool:
    """Brackets are about 11 standard errors wide; they pay when groups are large and there are many of them."""
    share = sum(11.2 * math.sqrt(p * (1 - p) / max(rows, 1)) for p in probs)
    return replicates >= 10 * PILOTS and share <= BRACKET_SHARE


def _reduced(df: DataFrame, keys: list[str], shared: list[str], value: str, brackets: DataFrame, count: int, probes: int) -> DataFrame:
    """(keys, __v, __ok): values inside a bracket as they are, the others as the end of the last bracket below."""
    v = quoted(value)
    inside = " or ".join(f"{v} between __lo{i} and __hi{i}" for i in range(probes))
    below = ", ".join(f"if(__hi{i} < {v}, __hi{i}, double('-infinity'))" for i in range(probes))
    joined = null_safe_join(df.select(*keys, value), small(brackets, count), shared) \
        .na.fill({f"__lo{i}": float("-inf") for i in range(probes)}).na.fill({f"__hi{i}": float("inf") for i in range(probes)}) \
        .selectExpr(*map(quoted, keys), v, f"{v} is null or {inside} as __ok", f"greatest({below}, double('-infinity')) as __below")
    return joined.selectExpr(*map(quoted, keys), f"if(__ok, {v}, __below) as __v", "__ok")


def bracketed_quantiles(df: DataFrame, shared: Sequence[str], replicate: str, pilots: Sequence, value: str, probs: Sequence[float],
                        qtype: int = 7, largest: int | None = None) -> DataFrame:
    """``grouped_quantiles`` by (shared, replicate), for many replicates of the same groups.

    The quantiles of the ``pilots`` give a bracket per group and probability. Only values inside brackets are shuffled one by one;
    all others are counted before the shuffle. A group whose quantile falls outside its bracket is computed again in full, so
    the result is exact whatever the pilots showed.
    """
    shared, probs = list(shared), [float(p) for p in probs]
    keys = [*shared, replicate]
    trial = materialize(df.filter(F.col(replicate).isin(list(pilots))).select(*keys, value))
    seen = grouped_quantiles(trial, keys, value, probs, qtype, largest=largest, split_keys=shared)
    ends = []
    for i in range(len(probs)):
        low, high = F.min(F.col("q")[i]), F.max(F.col("q")[i])
        # One more range on both sides; anything undefined leaves the bracket open.
        ends += [F.coalesce(F.nanvl(low - (high - low), F.lit(None)), F.lit(float("-inf"))).alias(f"__lo{i}"),
                 F.coalesce(F.nanvl(high + (high - low), F.lit(None)), F.lit(float("inf"))).alias(f"__hi{i}")]
    brackets, count = compact(seen.groupBy(*shared).agg(*ends))
    inside = _reduced(trial, keys, shared, value, brackets, count, len(probs)).filter("__ok")
    if group_sizes(inside, keys)[1] > split_rows(df.sparkSession):
        return grouped_quantiles(df, keys, value, probs, qtype, largest=largest, split_keys=shared)

    # Groups that no pilot has are not in the brackets; open ones keep all their values.
    counted = _reduced(df, keys, shared, value, brackets, count, len(probs)).groupBy(*keys, "__v", "__ok").agg(F.count(F.lit(1)).alias("__c"))
    by = ", ".join(map(quoted, keys))
    spec = f"(partition by {by} order by __v asc nulls last, __ok desc"
    ranked = counted.selectExpr(
        "*", f"sum(__c) over {spec} rows between unbounded preceding and current row) as __upto",
        f"lead(__v) over {spec}) as __next", f"lead(__ok) over {spec}) as __next_ok",
        f"sum(if(__v is null, 0L, __c)) over {spec} rows between unbounded preceding and unbounded following) as __n")
    picks = []
    for i, p in enumerate(probs):
        lo, hi, weight = ranks("__n", p, qtype)
        here = f"__v is not null and {lo} > __upto - __c and {lo} <= __upto"
        upper = f"if({hi} > __upto, __next, __v)"
        picks += [F.expr(f"max(case when {here} then {interpolate('__v', upper, weight)} end) as __q{i}"),
                  F.expr(f"max(case when {here} then not __ok or ({hi} > __upto and not __next_ok) end) as __miss{i}")]
    probes = range(len(probs))
    got = ranked.groupBy(*keys).agg(F.expr("max(__n) as n"), *picks)
    got = materialize(got.selectExpr(*map(quoted, keys), "n", f"array({', '.join(f'__q{i}' for i in probes)}) as q",
                                     " or ".join(f"coalesce(__miss{i}, false)" for i in probes) + " as __miss"))
    missed = got.filter("__miss").select(*keys)
    again = missed.count()
    if not again:
        return got.drop("__miss")
    rows = null_safe_join(df.select(*keys, value), small(missed, again), keys, "left_semi")
    redone = grouped_quantiles(rows, keys, value, probs, qtype, largest=largest, split_keys=shared)
    return got.filter("not __miss").drop("__miss").unionByName(redone)


#: Cells of values per group of the counting pass, replicates that place their borders, and the most counters that it may have.
CELLS, CELL_PILOTS, MOST_COUNTERS = 64, 3, 2_000_000


#: Set to true where the network is the bottleneck: the counting pass reads the rows twice and shuffles few of them.
COUNTING_CONF = "predcheck.countingPass"


def counting_pays(rows: int, groups: int, replicates: int) -> bool:
    """A counting pass can pay when groups have many more rows than cells, and its counters are few."""
    return replicates >= 20 and rows >= 8 * CELLS * max(groups, 1) and groups * replicates * CELLS <= MOST_COUNTERS


def counted_quantiles(df: DataFrame, shared: Sequence[str], replicate: str, pilots: Sequence, value: str, probs: Sequence[float], qtype: int = 7,
                      sums: dict[str, Column] | None = None, limit: int | None = None) -> DataFrame:
    """``grouped_quantiles`` by (shared, replicate) in two passes over the rows, for some dozens of replicates of the same groups.

    Cell borders that all replicates of a group share are placed by the ``pilots``. The first pass counts the values of each cell before the shuffle; the
    second shuffles only the values of cells that hold a wanted rank. Ties at a border are a cell that needs no second pass. The result
    is exact whatever the pilots showed: a group that none of them has is one cell. ``sums`` names further sums, of which the result has the totals.
    """
    shared, probs, sums = list(shared), [float(p) for p in probs], sums or {}
    keys, limit = [*shared, replicate], limit or split_rows(df.sparkSession)
    points = F.percentile_approx(value, [i / CELLS for i in range(1, CELLS)], 20 * CELLS)
    borders, count = compact(df.filter(F.col(replicate).isin(list(pilots))).groupBy(*shared).agg(F.array_sort(F.array_distinct(points)).alias("__s")))
    v = F.col(value)
    tagged = null_safe_join(df, small(borders, count, 64 + 8 * CELLS), shared).withColumn("__below", passed(F.col("__s"), lambda s: s < v, CELLS))
    cell = F.coalesce(2 * F.col("__below") + F.coalesce(F.get("__s", F.col("__below")) == v, F.lit(False)).cast("int"), F.lit(0))
    tagged = tagged.withColumn("__cell", F.when(v.isNotNull(), cell)).drop("__s", "__below")
    parts = materialize(tagged.groupBy(*keys, "__cell").agg(F.count(value).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max"),
                                                            *[c.alias(n) for n, c in sums.items()]))
    totals = parts.groupBy(*keys).agg(F.sum("__n").alias("n"), *[F.sum(n).alias(n) for n in sums])
    wanted = ", ".join(r for p in probs for r in ranks("n", p, qtype)[:2])
    wants = totals.filter("n > 0").selectExpr(*map(quoted, keys), f"explode(array_distinct(array({wanted}))) as r")
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell")) - F.col("__n")
    spans = parts.filter("__cell is not null").withColumn("__before", before)
    hits = materialize(null_safe_join(spans, wants, keys, "inner").filter("r > __before and r <= __before + __n").select(*keys, "__cell", "r", "__before", "__n", "__min", "__max"))
    found = hits.filter("__min = __max").select(*keys, "r", F.col("__min").alias("v"))
    rest = hits.filter("__min <> __max")
    most, cells = rest.agg(F.max("__n"), F.count(F.lit(1))).first()
    if cells:
        inner = [*keys, "__cell"]
        rows = null_safe_join(tagged.select(*inner, value), small(rest.select(*inner).distinct(), cells), inner, "left_semi")
        local = rest.select(*inner, F.col("r").alias("__r"), F.expr("r - __before").alias("r"))
        if most > limit:
            rows = materialize(rows)
        picked = select_ranks(rows, inner, value, local.drop("__r"), most, [*shared, "__cell"], limit)
        found = found.unionByName(null_safe_join(local, picked, [*inner, "r"], "inner").select(*keys, F.col("__r").alias("r"), "v"))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("__m"))
    return _from_ranks(null_safe_join(totals, found, keys, "left"), probs, qtype, [*keys, "n", *sums])
