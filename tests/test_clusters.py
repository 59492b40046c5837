"""Clusters against brute force, with so few cells at a time that every stratum is refined over several rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import predcheck as pk
from predcheck.operators import clusters
from predcheck.operators.binning import BinRule, fit_bins


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n, digits in (("a", 2500, 2), ("b", 500, 2), ("c", 40, 0), ("d", 2, 2), ("e", 60, 3)):
        x = np.round(rng.gamma(2, 40, n) if name != "e" else 10.0 ** rng.uniform(-3, 6, n), digits)
        rows += [(name, float(v)) for v in x]
    frame = spark.createDataFrame(rows, "s string, __x double").withColumn("__id", F.lit(0)).repartition(6).cache()
    return frame, {s: np.array([v for t, v in rows if t == s]) for s in "abcde"}


@pytest.fixture(params=["24", "1024"])
def few_cells(spark, request):
    spark.conf.set(clusters.CELLS_CONF, request.param)
    yield
    spark.conf.unset(clusters.CELLS_CONF)


def least_cost(x, k, absolute):
    """Dynamic programming over all pairs of distinct values."""
    v, w = np.unique(x, return_counts=True)
    m = len(v)
    cost = np.full((m, m), np.inf)
    sorted_x, upto = np.sort(x), np.cumsum(w)
    total = np.concatenate([[0.0], np.cumsum(sorted_x)])
    square = np.concatenate([[0.0], np.cumsum((sorted_x - x.mean()) ** 2)])
    shifted = np.concatenate([[0.0], np.cumsum(sorted_x - x.mean())])
    for i in range(m):
        f = upto[i] - w[i]
        t = upto[i:]
        if absolute:
            mid = (f + t - 1) // 2
            at = sorted_x[mid]
            cost[i, i:] = at * (mid + 1 - f) - (total[mid + 1] - total[f]) + (total[t] - total[mid + 1]) - at * (t - mid - 1)
        else:
            cost[i, i:] = square[t] - square[f] - (shifted[t] - shifted[f]) ** 2 / (t - f)
    best = cost[0]
    for _ in range(1, min(k, m)):
        best = np.concatenate([[np.inf], (best[:-1, None] + cost[1:]).min(axis=0)[1:]])
    return best[-1]


@pytest.mark.parametrize("method", ["fisher", "kmeans", "pam"])
def test_least_cost(data, few_cells, method):
    frame, values = data
    table = {r.s: np.array(r["__cuts"]) for r in fit_bins(frame, BinRule(method=method, nbins=4), ["s"]).table.collect()}
    for s, x in values.items():
        cuts = table[s]
        if method == "pam":
            got = np.abs(x[:, None] - cuts[None]).min(1).sum()
        else:
            part = np.searchsorted(cuts[1:-1], x, side="right")
            got = sum(((x[part == p] - x[part == p].mean()) ** 2).sum() for p in np.unique(part))
        assert got == pytest.approx(least_cost(x, 4, method == "pam"), rel=1e-9, abs=1e-6), s


@pytest.mark.parametrize("linkage", ["complete", "single", "average"])
def test_agglomeration(data, few_cells, linkage):
    frame, values = data
    table = {r.s: r["__cuts"] for r in fit_bins(frame, BinRule(method="hclust", nbins=4, options={"linkage": linkage}), ["s"]).table.collect()}
    for s, x in values.items():
        v, w = np.unique(x, return_counts=True)
        groups = [(a, a, float(n), a) for a, n in zip(v, w)]  # lowest, highest, weight, mean
        while len(groups) > 4:
            gap = [{"complete": b[1] - a[0], "single": b[0] - a[1], "average": b[3] - a[3]}[linkage] for a, b in zip(groups, groups[1:])]
            i = int(np.argmin(gap))
            a, b = groups[i:i + 2]
            groups[i:i + 2] = [(a[0], b[1], a[2] + b[2], (a[2] * a[3] + b[2] * b[3]) / (a[2] + b[2]))]
        want = [(a[1] + b[0]) / 2 for a, b in zip(groups, groups[1:])]
        if linkage != "single":  # equal gaps abound between rounded values
            assert table[s][1:-1] == pytest.approx(want), s
        else:
            assert len(table[s]) == len(want) + 2


def update(linkage, d, i, j, n):
    """Distances of the cluster of i and j from all others, by the textbook rules of agglomeration on distances |x - y|."""
    a, b, k = n[i], n[j], n
    if linkage == "mcquitty":
        return (d[i] + d[j]) / 2
    if linkage == "median":
        return (d[i] + d[j]) / 2 - d[i, j] / 4
    if linkage == "centroid":
        return (a * d[i] + b * d[j]) / (a + b) - a * b * d[i, j] / (a + b) ** 2
    if linkage == "average":
        return (a * d[i] + b * d[j]) / (a + b)
    return ((a + k) * d[i] + (b + k) * d[j] - k * d[i, j]) / (a + b + k)  # Ward


def merged_groups(x, k, linkage):
    """k groups of values by merging the closest pair of all pairs; rows of equal value start as single clusters."""
    x = np.sort(x)
    d = np.abs(x[:, None] - x[None])
    if linkage == "ward.D2":
        d = d ** 2
    n, groups, live = np.ones(len(x)), [[v] for v in x], np.ones(len(x), bool)
    d[np.diag_indices(len(x))] = np.inf
    while len({v for g, here in zip(groups, live) if here for v in g[:1]}) > k or live.sum() > k:
        i, j = sorted(np.unravel_index(np.argmin(np.where(live[:, None] & live[None], d, np.inf)), d.shape))
        row = update(linkage, d, i, j, n)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        n[i], live[j] = n[i] + n[j], False
        groups[i] = groups[i] + groups[j]
    return sorted((min(g), max(g)) for g, here in zip(groups, live) if here)


@pytest.mark.parametrize("linkage", ["mcquitty", "centroid", "median", "ward.D", "ward.D2", "average"])
def test_linkages_against_all_pairs(spark, linkage):
    rng = np.random.default_rng(8)
    values = {"a": rng.gamma(2, 40, 90), "b": np.concatenate([rng.normal(0, 1, 60), rng.normal(9, 3, 50)]), "c": np.repeat(rng.uniform(0, 90, 30), rng.integers(1, 9, 30))}
    frame = spark.createDataFrame([(s, float(v)) for s, x in values.items() for v in x], "s string, __x double").repartition(5)
    spark.conf.set(clusters.CELLS_CONF, "48")  # the larger strata merge in rounds first
    try:
        table = {r.s: r["__cuts"] for r in fit_bins(frame, BinRule(method="hclust", nbins=5, options={"linkage": linkage}), ["s"]).table.collect()}
    finally:
        spark.conf.unset(clusters.CELLS_CONF)
    for s, x in values.items():
        groups = merged_groups(x, 5, linkage)
        assert table[s] == pytest.approx([x.min(), *[(a[1] + b[0]) / 2 for a, b in zip(groups, groups[1:])], x.max()]), s


def test_bagging_is_stable(data, few_cells):
    frame, _ = data
    rule = BinRule(method="bclust", nbins=4, options={"iter_base": 3, "base_centers": 8})
    first, again = ({r.s: r["__cuts"] for r in fit_bins(f, rule, ["s"]).table.collect()} for f in (frame, frame.repartition(2)))
    assert first == again and all(len(c) <= 5 and list(c) == sorted(c) for c in first.values())


def test_poisson_weights(spark):
    draws = spark.range(20_000).select(F.lit(5).cast("long").alias("h"), F.col("id").cast("double").alias("x"), (F.col("id") % 4 * 250 + 1).cast("double").alias("w"))
    got = draws.withColumn("n", clusters.poisson(1, 0)("h", "x", "w")).groupBy("w").agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).collect()
    for r in got:
        assert r.m == pytest.approx(r.w, rel=0.05) and r.v == pytest.approx(r.w, rel=0.1)


def test_unknown_options_are_refused(data):
    frame, _ = data
    for method, options in (("hclust", {"linkage_typo": "average"}), ("ntile", {"type": 7}), ("equal", {"seed": 1}), ("dpih", {"level": 2})):
        with pytest.raises(ValueError, match="does not know"):
            pk.assign_bins(frame, "__x", BinRule(method=method, nbins=3, options=options), ["s"], "__id")
    with pytest.raises(ValueError, match="linkage is"):
        fit_bins(frame, BinRule(method="hclust", nbins=3, options={"linkage": "ward"}), ["s"])
