"""One-dimensional clustering of every stratum, with one answer at every size.

Optimal one-dimensional clusters are intervals of the sorted values. ``fisher``, ``jenks``, ``kmeans`` and ``pam`` look for the
k intervals of least squared or absolute deviation. Each stratum is summarised by cells of neighbouring values; a dynamic program over the
cells gives a solution, and another one, which pays nothing for the cells that hold a cut, a lower bound for every place
of every cut. Cells in which an optimal cut (or median) cannot lie are settled and merged; the others are split, on the executors, until they
hold one value each. The result is then the optimum over all values. A task holds the cells of a stratum and k numbers for each, no matrix: about
CELLS at first, and as the cells get finer those near a cut, whose number grows with the square root of the number of values.

``hclust`` merges pairs of clusters that are each other's nearest neighbour, all at once, and notes at which height each border
between neighbouring values disappears: the cut into k clusters is at the k - 1 highest borders. ``bclust`` resamples all values by weights
from a hash and clusters each resample like ``kmeans``.
"""

from __future__ import annotations

import heapq
from statistics import NormalDist
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.quantiles import grouped_quantiles
from ..functions.values import null_safe_join
from ..plans.storage import compact, materialize, small
from .align import dense_index

#: Cells that a stratum is cut into at a time, and clusters that one task finishes merging. Neither changes a result.
CELLS = 1024
CELLS_CONF = "predcheck.clusterCells"

# Number of resamples and base centres of bagged clustering; grid size of the plug-in width.
BAGS, BASE_CENTERS, GRID = 10, 20, 401


# ------------------------------------------------------------------------------ helpers on one small table

class Costs:
    """Cost of one cluster over the cells i..j, in constant time from prefix sums; nothing for an empty range (j < i).

    Squared deviations are exact. For absolute ones a cell costs what its weight at its mean would, and not less than ``dev``, a lower bound of its own least
    cost: exact where the centre lies outside the cell, a lower bound inside it. Both kinds are least costs of one centre under convex functions
    ordered like the cells, so they meet the quadrangle inequality: the best last cut moves up with the end of a range, and layers of the dynamic program need no matrix.
    """

    def __init__(self, cells: dict, absolute: bool):
        self.w, self.s, self.q = (np.concatenate([[0.0], np.cumsum(cells[c])]) for c in ("w", "s", "q"))
        self.lo, self.absolute, self.cells = cells["lo"], absolute, len(cells["w"])
        self.own = {c: cells[c] for c in ("w", "s")} | {"dev": cells.get("dev", np.zeros(self.cells))}

    def median(self, i, j) -> np.ndarray:
        """The cell of the lower median of the cells i..j, from cumulative weights."""
        half = self.w[i] + (self.w[j + 1] - self.w[i]) / 2
        mid = np.searchsorted(self.w[1:], half - 1e-9 * max(1.0, self.w[-1] * 1e-6))
        return np.clip(mid, i, j)

    def __call__(self, i, j) -> np.ndarray:
        i, j = np.broadcast_arrays(i, j)
        empty, j = j < i, np.maximum(i, j)
        i, j = np.minimum(i, self.cells - 1), np.minimum(j, self.cells - 1)
        if self.absolute:
            # only the median's cell can cost more than its weight at its mean; the best centre is where it begins to
            mid = self.median(i, j)
            w, s, dev = (self.own[c][mid] for c in ("w", "s", "dev"))
            before, after = self.w[mid] - self.w[i], self.w[j + 1] - self.w[mid + 1]
            center = (s - np.sign(before - after) * dev) / w
            cost = center * (before - after) - (self.s[mid] - self.s[i]) + (self.s[j + 1] - self.s[mid + 1]) + np.maximum(np.abs(s - w * center), dev)
        else:
            moment = self.s[j + 1] - self.s[i]
            cost = (self.q[j + 1] - self.q[i]) - moment * moment / (self.w[j + 1] - self.w[i])
        return np.where(empty, 0.0, np.maximum(cost, 0.0))

    def reached(self, i, j) -> np.ndarray:
        """Cost of a cluster about a centre that exists: an upper bound, exact if the median's cell holds one value."""
        if not self.absolute:
            return self(i, j)
        mid, w, s = self.median(i, j), self.w, self.s
        center = self.lo[mid]
        return center * (w[mid] - w[i]) - (s[mid] - s[i]) + (s[j + 1] - s[mid]) - center * (w[j + 1] - w[mid])


def monotone_minima(before: np.ndarray, cost) -> tuple[np.ndarray, np.ndarray]:
    """For every q the least ``before[p] + cost(p, q)`` over p <= q, and its first p, which never falls as q grows.

    All ends of one level of the halving are looked at together, so a level costs a few passes over one array."""
    n = len(before)
    best, at = np.full(n, np.inf), np.zeros(n, np.int64)
    stride = 1 << max(0, n - 1).bit_length()
    while stride:
        q = np.arange(stride - 1, n, 2 * stride)
        stride //= 2
        if not len(q):
            continue
        step = q[0] + 1
        low = np.where(q >= step, at[np.maximum(q - step, 0)], 0)
        high = np.minimum(np.where(q + step < n, at[np.minimum(q + step, n - 1)], n - 1), q)
        size = high - low + 1
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(q)), size)
        p = np.arange(len(of)) - start[of] + low[of]
        value = before[p] + cost(p, q[of])
        best[q] = np.minimum.reduceat(value, start)
        hit = np.flatnonzero(value == best[q][of])
        at[q] = p[hit[np.searchsorted(of[hit], np.arange(len(q)))]]
    return best, at


def best_intervals(costs: Costs, k: int) -> tuple[list[tuple[int, int]], float]:
    """The ``k`` intervals (first, last cell) of least total cost, and that cost."""
    m = costs.cells
    k = max(1, min(int(k), m))
    best, starts = costs(np.zeros(m, np.int64), np.arange(m)), []
    for _ in range(1, k):
        best, start = monotone_minima(np.concatenate([[np.inf], best[:-1]]), costs)
        starts.append(start)
    out, last = [], m - 1
    for start in reversed(starts):
        out.append((int(start[last]), last))
        last = int(start[last]) - 1
    out.append((0, last))
    return out[::-1], float(best[-1])


def undecided(costs: Costs, live: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(live cells that may hold a cut of a solution of cost at most ``most``, those and, for absolute deviations, cells that may hold its medians).

    A cell that holds a cut costs nothing, so the sums are lower bounds for every place of the cut within it."""
    m, cells = costs.cells, np.flatnonzero(live)
    n, limit = len(cells), most * (1 + 1e-9) + 1e-12
    found = np.zeros(m, bool)
    if n == 0:
        return found, found

    def ahead(p, q):
        return costs(cells[p] + 1, cells[q] - 1)

    def behind(p, q):
        return costs(cells[n - 1 - q] + 1, cells[n - 1 - p] - 1)

    forward, backward = [costs(np.zeros(n, np.int64), cells - 1)], [costs(cells + 1, np.full(n, m - 1))[::-1]]  # [j]: j + 1 clusters up to a cut in the cell, or after it
    for _ in range(2, k):
        forward.append(monotone_minima(forward[-1], ahead)[0])
        backward.append(monotone_minima(backward[-1], behind)[0])
    cuts = [np.flatnonzero(forward[j] + backward[k - 2 - j][::-1] <= limit) for j in range(k - 1)]
    for c in cuts:
        found[cells[c]] = True
    holds_cut = found.copy()
    if costs.absolute:
        # the median of a cluster lies between those of its least and its greatest possible ends; its cuts may take any part of their cells
        ranges = [(cells[c[0]], cells[c[-1]]) if len(c) else (0, m - 1) for c in cuts]
        for left, right in zip([None, *ranges], [*ranges, None]):
            a, b = (0, 0) if left is None else (left[0], left[1] + 1)
            c, d = (m - 1, m - 1) if right is None else (max(right[0] - 1, a), right[1])
            low, high = (costs.median(np.array([x]), np.array([y]))[0] for x, y in ((a, c), (min(b, d), d)))
            found[min(low, high):max(low, high) + 1] = True
    return holds_cut & live, found & live


def chosen_intervals(costs: Costs, live: np.ndarray, k: int, most: float) -> list[tuple[int, int]]:
    """The best intervals once no cell with a cut or median of a solution of cost ``most`` is to be split: only their
    ends are tried, by costs about centres that exist."""
    k, m = max(1, min(int(k), costs.cells)), costs.cells
    parts, _ = best_intervals(costs, k)
    if not costs.absolute or k == 1 or m <= k:
        return parts
    near = np.flatnonzero(undecided(costs, live, k, most)[0])
    starts = np.union1d(np.concatenate([near, near + 1]), [p[0] for p in parts])
    starts = np.concatenate([starts[(starts > 0) & (starts < m)], [m]])
    best, before = costs.reached(np.zeros(len(starts), np.int64), starts - 1), []
    for _ in range(1, k):
        options = [best[:q] + costs.reached(starts[:q], np.full(q, starts[q] - 1)) for q in range(1, len(starts))]
        before.append(np.array([0, *[o.argmin() for o in options]]))
        best = np.array([np.inf, *[o.min() for o in options]])
    out, last = [], len(starts) - 1
    for at in reversed(before):
        out.append((int(starts[at[last]]), int(starts[last]) - 1))
        last = int(at[last])
    return [(0, int(starts[last]) - 1), *out[::-1]]


def settle(cells: dict, k: int, absolute: bool, most: float = np.inf) -> tuple[dict, float]:
    """One step: runs of cells that can't hold a cut are merged for good; ``live`` flags the others. Also the least cost reached so far."""
    if len(cells["w"]) <= k:
        return cells, most
    costs = Costs(cells, absolute)
    i, j = (np.array(x) for x in zip(*best_intervals(costs, k)[0]))
    most = min(most, float(costs.reached(i, j).sum()))
    found = undecided(costs, cells["live"], k, most)[1]
    run = np.concatenate([[0], np.cumsum(found[1:] | found[:-1])])  # a new run wherever either neighbour is undecided
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    last = np.append(first[1:], len(run)) - 1
    dev = np.where(first == last, cells["dev"][first], costs(first, last)) if absolute else cells["dev"][first]
    return {"lo": cells["lo"][first], "hi": cells["hi"][last], **{c: np.add.reduceat(cells[c], first) for c in ("w", "s", "q", "d")}, "dev": dev, "live": found[first]}, most


#: Linkages of agglomeration, under the names that users of hierarchical clustering know (fixed values).
LINKAGES = ("complete", "single", "average", "mcquitty", "centroid", "median", "ward.D", "ward.D2")
#: Linkages whose clusters count alike when they merge, whatever their sizes.
_EQUAL_PARTS = ("mcquitty", "median")


class Cluster(NamedTuple):
    """Ends, weight and spread of an interval of values, as numbers or Columns. Beside complete and single linkage both ends are its centre."""
    lo: Any
    hi: Any
    w: Any
    spread: Any


def distance(linkage: str, a: Cluster, b: Cluster):
    """Distance of a cluster from the next higher one.

    The update rules of the linkages on distances |x - y| have closed forms for neighbouring intervals: the distance of their centres, for centroid,
    median and ``ward.D`` less a spread that each cluster brings along. Every such distance adds up, d(a, c) = d(a, b) + d(b, c) + 2 spread(b), so
    the nearest cluster is always a neighbour and merging never brings a third one nearer: reciprocal neighbours may merge in any order, and heights never fall.
    """
    if linkage == "single":
        return b.lo - a.hi
    if linkage == "complete":
        return b.hi - a.lo
    apart = b.lo - a.lo
    if linkage in ("average", "mcquitty"):
        return apart
    share = 2 * a.w * b.w / (a.w + b.w)
    if linkage == "ward.D2":
        return share * apart * apart  # its square, which orders alike
    apart = apart - a.spread - b.spread
    return share * apart if linkage == "ward.D" else apart


def joined(linkage: str, a: Cluster, b: Cluster) -> Cluster:
    """The cluster of two neighbours."""
    if linkage in ("single", "complete"):
        return Cluster(a.lo, b.hi, a.w + b.w, a.spread)
    total = a.w + b.w
    p, q = (0.5, 0.5) if linkage in _EQUAL_PARTS else (a.w / total, b.w / total)
    center = (a.lo + b.lo) * 0.5 if linkage in _EQUAL_PARTS else (a.w * a.lo + b.w * b.lo) / total
    spread = p * a.spread + q * b.spread + p * q * (b.lo - a.lo - a.spread - b.spread)
    return Cluster(center, center, total, spread)


def border_heights(low: np.ndarray, high: np.ndarray, weight: np.ndarray, linkage: str, spread: np.ndarray | None = None) -> np.ndarray:
    """The height at which each border between sorted neighbouring clusters disappears."""
    n = len(low)
    parts = [Cluster(*map(float, row)) for row in zip(low, high, weight, np.zeros(n) if spread is None else spread)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heights = np.zeros(max(0, n - 1))

    def gap(i, j):
        return distance(linkage, parts[i], parts[j])

    heap = [(gap(i, i + 1), i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    version, border, top = [0] * n, list(range(n)), 0.0
    while heap:
        h, i, j, vi, vj = heapq.heappop(heap)
        if version[i] != vi or version[j] != vj:
            continue
        top = max(top, h)
        heights[border[i]] = top
        parts[i] = joined(linkage, parts[i], parts[j])
        border[i], right[i] = border[j], right[j]
        version[i] += 1
        version[j] = -1
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (gap(i, right[i]), i, right[i], version[i], version[right[i]]))
        if left[i] >= 0:
            heapq.heappush(heap, (gap(left[i], i), left[i], i, version[left[i]], version[i]))
    return heights


def plug_in_width(counts: np.ndarray, delta: float) -> float:
    """Direct plug-in histogram bin width (Wand 1997), two stages, for linearly binned standardised data."""
    n = counts.sum()

    def functional(order: int, h: float) -> float:
        reach = min(int((4 + order) * h / delta), len(counts) - 1)
        z = np.arange(-reach, reach + 1) * delta / h
        density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
        hermite = z * z - 1 if order == 2 else z ** 4 - 6 * z * z + 3
        kernel = hermite * density / h ** (order + 1)
        return float(counts @ np.convolve(counts, kernel, mode="full")[reach:reach + len(counts)]) / n ** 2

    fourth = functional(4, (2 / (5 * n)) ** (1 / 7) * np.sqrt(2))
    second = functional(2, (np.sqrt(2 / np.pi) / (fourth * n)) ** (1 / 5))
    return float((6 / (-second * n)) ** (1 / 3))


# ------------------------------------------------------------------------------------------- Spark side

def _per_group(cells: DataFrame, strata: list[str], fn) -> DataFrame:
    """Run ``fn(cells of one stratum, sorted) -> list of numbers`` for every stratum."""
    fields = [cells.schema[s] for s in strata] + [T.StructField("cuts", T.ArrayType(T.DoubleType()))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo").reset_index(drop=True)
        row = {s: [pdf[s].iloc[0]] for s in strata}
        return pd.DataFrame({**row, "cuts": [[float(v) for v in fn(pdf)]]})

    return cells.groupBy(*strata).applyInPandas(run, T.StructType(fields))


def _numbered(values: DataFrame, strata: list[str]) -> tuple[DataFrame, DataFrame]:
    """(strata -> g, one row each; (g, x, w) of the distinct values), both stored."""
    groups = materialize(values.select(*strata).distinct().withColumn("g", F.monotonically_increasing_id()))
    distinct = values.groupBy(*strata, "x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return groups, materialize(null_safe_join(distinct, groups, strata, "inner").select("g", "x", "w"))


CELL = "g long, lo double, hi double, w double, s double, q double, d double, dev double, live boolean, k int, shift double, pieces int, most double"
_SUMS = ("w", "s", "q", "d")


def _arrays(pdf: pd.DataFrame) -> tuple[dict, float, int, np.ndarray, np.ndarray]:
    """Sorted cells about the stratum's mean, the mean, k, and the cells' ends as they are in the data."""
    shift = float(pdf["shift"].iloc[0])
    lo, hi = pdf["lo"].to_numpy(float), pdf["hi"].to_numpy(float)
    cells = {"lo": lo - shift, "hi": hi - shift, "live": pdf["live"].to_numpy(bool), **{c: pdf[c].to_numpy(float) for c in (*_SUMS, "dev")}}
    return cells, shift, int(pdf["k"].iloc[0]), lo, hi


def _optimum(values: DataFrame, wanted: DataFrame, absolute: bool, cells: int) -> DataFrame:
    """(g, parts): the k intervals of least cost of each g as arrays of (a, b, m, mean): lowest, highest and median value, and mean.

    ``values`` is (g, x, w), one row per distinct value; ``wanted`` (g, k)."""
    spans = values.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("shift"),
                                    F.count(F.lit(1)).cast("double").alias("d"))
    zero = F.lit(0.0)
    table = spans.join(wanted, "g").select("g", "lo", "hi", zero.alias("w"), zero.alias("s"), zero.alias("q"), "d", zero.alias("dev"), F.lit(True).alias("live"), "k", "shift",
                                           F.lit(cells).alias("pieces"), F.lit(float("inf")).alias("most"))
    table, live, opened = materialize(table), values, F.lit(True)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        own, shift, k, lo, hi = _arrays(pdf)
        new, most = settle(own, k, absolute, float(pdf["most"].min()))
        to_split = int((new["live"] & (new["hi"] > new["lo"])).sum())
        # as many parts that a stratum's cells stay about as many
        return pd.DataFrame({"g": pdf["g"].iloc[0], "lo": lo[np.searchsorted(own["lo"], new["lo"])], "hi": hi[np.searchsorted(own["hi"], new["hi"])],
                             **{c: new[c] for c in (*_SUMS, "dev")}, "live": new["live"], "k": k, "shift": shift, "pieces": max(4, cells // max(1, to_split)), "most": most})

    while True:
        # the first round splits the whole stratum, even if it has one value; its sums are not known yet
        cuts = table.filter(opened & F.col("live")).select("g", "lo", "hi", "d", "k", "shift", "pieces", "most")
        n = cuts.count()
        if not n:
            break
        near = small(cuts.withColumnRenamed("g", "__g"), n)
        inside = live.join(near, (F.col("g") == F.col("__g")) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        inside = materialize(inside.select("g", "x", "w", "lo", "hi", "d", "k", "shift", "pieces", "most"))
        part = F.least(F.col("pieces") - 1, F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("pieces"))).cast("double")
        place = F.when(F.col("d") <= F.col("pieces"), F.col("x")).otherwise(part)  # few values: each a cell of its own
        off = F.col("x") - F.col("shift")
        new = inside.groupBy("g", "lo", place.alias("place"), "k", "shift", "pieces", "most").agg(
            F.min("x").alias("a"), F.max("x").alias("b"), F.sum("w").alias("w"), F.sum(F.col("w") * off).alias("s"), F.sum(F.col("w") * off * off).alias("q"),
            F.count(F.lit(1)).cast("double").alias("d"))
        new = new.select("g", F.col("a").alias("lo"), F.col("b").alias("hi"), *_SUMS, zero.alias("dev"), F.lit(True).alias("live"), "k", "shift", "pieces", "most")
        rows = new.unionByName(table.filter(~(opened & F.col("live"))))
        table = materialize(rows.groupBy("g").applyInPandas(step, CELL))
        live, opened = inside.select("g", "x", "w"), F.col("hi") > F.col("lo")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own, shift, k, lo, hi = _arrays(pdf.sort_values("lo"))
        costs = Costs(own, absolute)
        out = []
        for a, b in chosen_intervals(costs, own["live"], k, float(pdf["most"].min())):
            mid = costs.median(np.array([a]), np.array([b]))[0]
            out.append({"a": lo[a], "b": hi[b], "m": lo[mid], "mean": shift + own["s"][a:b + 1].sum() / own["w"][a:b + 1].sum()})
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "parts": [out]})

    return table.groupBy("g").applyInPandas(solve, "g long, parts array<struct<a: double, b: double, m: double, mean: double>>")


def _merged(values: DataFrame, wanted: DataFrame, linkage: str, cells: int) -> DataFrame:
    """(g, cuts): breaks from the lowest to the highest value at the k - 1 borders that agglomeration keeps longest."""
    fields = ("lo", "hi", "w", "spread")
    rows = values.select("g", F.col("x").alias("lo"), F.col("x").alias("hi"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("spread"), F.col("x").alias("first"), F.col("x").alias("last"))
    here, following = Cluster(*map(F.col, fields)), Cluster(*(F.col(f"n_{c}") for c in fields))
    borders = None
    while (rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > cells:
        # clusters in order of their position; neighbours are found by position, so no stratum is in one task
        at = dense_index(rows, ["g", "first"], "at")
        sides = at.select("g", *fields, "first", "last", "at")
        after = sides.select("g", (F.col("at") - 1).alias("at"), *[F.col(c).alias(f"n_{c}") for c in (*fields, "first", "last")])
        pairs = materialize(sides.join(after, ["g", "at"], "left").withColumn("gap", distance(linkage, here, following)))
        left = pairs.select("g", (F.col("at") + 1).alias("at"), F.col("gap").alias("gap_left"))
        right = pairs.select("g", (F.col("at") - 1).alias("at"), F.col("gap").alias("gap_right"))
        # of equal gaps the left one is nearer, so exactly one border of every tie is chosen
        chosen = pairs.join(left, ["g", "at"], "left").join(right, ["g", "at"], "left").withColumn(
            "joins", F.expr("gap is not null and (gap_left is null or gap < gap_left) and (gap_right is null or gap <= gap_right)"))
        chosen = materialize(chosen)
        gone = chosen.filter("joins").select("g", F.col("last").alias("below"), F.col("n_first").alias("above"), F.col("gap").alias("height"))
        borders = gone if borders is None else borders.unionByName(gone)
        taken = chosen.filter("joins").select("g", (F.col("at") + 1).alias("at"), F.lit(True).alias("taken"))
        kept = chosen.join(taken, ["g", "at"], "left_anti")
        both = joined(linkage, here, following)
        rows = materialize(kept.select("g", *[F.when(F.col("joins"), c).otherwise(F.col(n)).alias(n) for n, c in zip(fields, both)], "first",
                                       F.when(F.col("joins"), F.col("n_last")).otherwise(F.col("last")).alias("last")))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        heights = border_heights(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["w"].to_numpy(), linkage, pdf["spread"].to_numpy())
        below, above = pdf["last"].to_numpy()[:-1], pdf["first"].to_numpy()[1:]
        return pd.DataFrame({"g": pdf["g"].iloc[0] if len(pdf) else 0, "below": below, "above": above, "height": heights})

    rest = rows.groupBy("g").applyInPandas(finish, "g long, below double, above double, height double")
    every = rest if borders is None else rest.unionByName(borders)
    # a border outlasts those below it in height; of equal heights the lower border goes first
    place = Window.partitionBy("g").orderBy(F.col("height").desc(), F.col("below").desc())
    kept = every.join(wanted, "g").withColumn("place", F.row_number().over(place)).filter("place < k")
    cuts = kept.groupBy("g").agg(F.array_sort(F.collect_list((F.col("below") + F.col("above")) / 2)).alias("inner"))
    ends = values.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    none = F.array().cast("array<double>")
    return ends.join(cuts, "g", "left").select("g", F.concat(F.array("a"), F.coalesce("inner", none), F.array("b")).alias("cuts"))


def poisson(seed: int, bag: int):
    """Column function (h, x, w) -> a Poisson number of mean w, from a hash of all but w."""
    def draw(h: pa.Array, x: pa.Array, w: pa.Array) -> pa.Array:
        key = (h.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (x.to_numpy().view(np.uint64) + np.uint64(seed * 1000 + bag))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
        u = ((key ^ (key >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
        mean = w.to_numpy().astype(float)
        out, chance = np.zeros(len(u)), np.exp(-np.minimum(mean, 600.0))
        total, low = chance.copy(), mean <= 600
        step = 0
        while (left := low & (u > total) & (step < 1200)).any():  # the number whose cumulative chance reaches u
            step += 1
            chance = chance * mean / step
            total = np.where(left, total + chance, total)
            out[left] = step
        if (~low).any():
            out[~low] = np.maximum(0, np.round(mean[~low] + np.sqrt(mean[~low]) * np.array([NormalDist().inv_cdf(min(max(v, 1e-12), 1 - 1e-12)) for v in u[~low]])))
        return pa.array(out)

    return F.arrow_udf(draw, "double")


def _bagged(values: DataFrame, wanted: DataFrame, cells: int, seed: int, bags: int, base: int) -> DataFrame:
    """(g, cuts), from (g, h, x, w), of bagged clustering: ``base`` centres of each of ``bags`` resamples, merged by average linkage."""
    drawn = None
    for bag in range(bags):
        one = values.select("g", F.lit(bag).alias("bag"), "x", poisson(seed, bag)("h", "x", "w").alias("w")).filter("w > 0")
        drawn = one if drawn is None else drawn.unionByName(one)
    drawn = materialize(drawn)
    numbers = materialize(drawn.select("g", "bag").distinct().withColumn("own", F.monotonically_increasing_id()))
    drawn = drawn.join(small(numbers, numbers.count()), ["g", "bag"]).select(F.col("own").alias("g"), "x", "w")
    parts = _optimum(materialize(drawn), numbers.select(F.col("own").alias("g"), F.lit(base).alias("k")), False, cells)
    centers = parts.select("g", F.explode("parts.mean").alias("x")).join(numbers.select(F.col("own").alias("g"), F.col("g").alias("group")), "g") \
        .groupBy("group", "x").agg(F.count(F.lit(1)).cast("double").alias("w")).select(F.col("group").alias("g"), "x", "w")
    cuts = _merged(materialize(centers), wanted, "average", max(cells, bags * base))
    ends = values.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return ends.join(cuts, "g").select("g", F.concat(F.array("a"), F.slice("cuts", 2, F.greatest(F.size("cuts") - 2, F.lit(0))), F.array("b")).alias("cuts"))


def fit(rows: DataFrame, strata: list[str], table: DataFrame, method: str, options: dict) -> DataFrame:
    """(strata, ``cuts``): medoids for ``pam``, otherwise breaks from the smallest to the largest value.

    ``rows`` holds (strata, __x); ``table`` one row per stratum with ``nbins``.
    """
    cells = int(rows.sparkSession.conf.get(CELLS_CONF, str(CELLS)))
    groups, values = _numbered(rows.filter(F.col("__x").isNotNull()).select(*strata, F.col("__x").alias("x")), strata)
    wanted = materialize(null_safe_join(groups, table.select(*strata, F.col("nbins").cast("int").alias("k")), strata, "inner").select("g", "k"))
    if method == "hclust":
        linkage = options.get("linkage", "complete")
        if linkage not in LINKAGES:
            raise ValueError(f"linkage is one of {', '.join(LINKAGES)}")
        cuts = _merged(values, wanted, linkage, cells)
    elif method == "bclust":
        # the same values are drawn alike in every stratum, so the bins of a stratum do not depend on its name
        hashed = values.select("g", F.lit(0).cast("long").alias("h"), "x", "w")
        cuts = _bagged(hashed, wanted, cells, int(options.get("seed", 1)), int(options.get("iter_base", BAGS)), int(options.get("base_centers", BASE_CENTERS)))
    else:
        parts = _optimum(values, wanted, method == "pam", cells)
        first, last = F.array(F.col("parts")[0]["a"]), F.array(F.element_at("parts", -1)["b"])
        if method == "pam":
            found = F.col("parts.m")
        elif method == "jenks":
            found = F.concat(first, F.col("parts.b"))
        else:
            inner = F.slice("parts", 1, F.size("parts") - 1)
            found = F.concat(first, F.transform(inner, lambda p, i: (p["b"] + F.col("parts")[i + 1]["a"]) / 2), last)
        cuts = parts.select("g", found.alias("cuts"))
    return groups.join(cuts, "g").drop("g")


def fit_plug_in(rows: DataFrame, strata: list[str], table: DataFrame, largest: int, grid: int = GRID) -> DataFrame:
    """Breaks of the plug-in bin width, from the smallest value on. Only grid counts leave the executors."""
    quartiles = grouped_quantiles(rows, strata, "__x", [0.25, 0.75], largest=largest)
    iqr = quartiles.select(*strata, ((F.col("q")[1] - F.col("q")[0]) / 1.349).alias("iqr"))
    scaled = null_safe_join(table, iqr, strata)
    scale = F.when(F.least("iqr", "sd") > 0, F.least("iqr", "sd"))
    scaled, groups = compact(scaled.withColumn("scale", scale).select(*strata, "xmin", "xmax", "scale"))
    if scaled.filter("scale is null").limit(1).count():
        raise ValueError("dpih needs a positive spread in every stratum")
    data = rows.filter(F.col("__x").isNotNull())
    at = (F.col("__x") - F.col("xmin")) / (F.col("xmax") - F.col("xmin")) * (grid - 1)
    cell = F.least(F.floor(at), F.lit(grid - 2)).cast("int")
    binned = null_safe_join(data, small(scaled, groups), strata, "inner").withColumn("at", at) \
        .groupBy(*strata, cell.alias("cell"), "xmin", "xmax", "scale").agg(
            F.sum(1 - (F.col("at") - cell)).alias("low"), F.sum(F.col("at") - cell).alias("high"))

    def solve(pdf):
        counts = np.zeros(grid)
        np.add.at(counts, pdf["cell"].to_numpy(int), pdf["low"].to_numpy(float))
        np.add.at(counts, pdf["cell"].to_numpy(int) + 1, pdf["high"].to_numpy(float))
        a, b, scale = (float(pdf[c].iloc[0]) for c in ("xmin", "xmax", "scale"))
        width = scale * plug_in_width(counts, (b - a) / scale / (grid - 1))
        return a + width * np.arange(int(np.ceil((b - a) / width)) + 1)

    return _per_group(binned.withColumn("lo", F.col("cell")), strata, solve)
