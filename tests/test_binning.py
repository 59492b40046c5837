import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from predcheck import BinRule, assign_bins
from predcheck.functions.breaks import interval_labels, with_pretty
from predcheck.operators.clusters import Costs, best_intervals, border_heights, plug_in_width


def frame(spark, xs, strat=None):
    strat = strat or ["s"] * len(xs)
    return spark.createDataFrame([(i, s, None if x is None else float(x)) for i, (s, x) in enumerate(zip(strat, xs))],
                                 "obs_id long, strat string, x double")


def numbers(df, column="bin_num"):
    return [r[column] for r in df.orderBy("obs_id").collect()]


def run(spark, xs, strat=None, by=("strat",), **rule):
    return assign_bins(frame(spark, xs, strat), "x", BinRule(**rule), list(by), "obs_id")


def test_rank_groups_are_not_sql_ntile(spark):
    assert numbers(run(spark, [1, 2, 3, 4, 5, 6], method="ntile", nbins=4)) == [1, 1, 2, 3, 3, 4]
    assert numbers(run(spark, [5, None, 5, 1], method="ntile", nbins=3)) == [2, None, 3, 1]
    assert numbers(run(spark, [3, 1], method="ntile", nbins=5)) == [3, 1]


def test_nearest_takes_the_lower_center_on_a_tie(spark):
    got = run(spark, [2, 4, 0, 9, None], method="centers", centers=[5, 3, 1, 3])
    assert numbers(got) == [1, 3, 1, 5, None]
    assert numbers(got, "bin") == ["1", "3", "1", "5", None]


def test_breaks(spark):
    got = run(spark, [1, 2, 3, 4, 5, 6], method="breaks", breaks=[4, 2])
    assert numbers(got, "bin") == ["[1,2)", "[2,4)", "[2,4)", "[4,6]", "[4,6]", "[4,6]"]
    right = run(spark, [1, 2, 3, 4, 5, 6], method="breaks", breaks=[4, 2], right=True)
    assert numbers(right, "bin") == ["[1,2]", "[1,2]", "(2,4]", "(2,4]", "(4,6]", "(4,6]"]
    assert numbers(run(spark, [2, 3], method="breaks", breaks=[0, 2.5, 10]), "bin") == ["[0,2.5)", "[2.5,10]"]
    assert numbers(run(spark, [7, 7], method="breaks", breaks=[7]), "bin") == ["[7,7]", "[7,7]"]


def test_one_equal_count_bin(spark):
    assert numbers(run(spark, [1, 2, 3], method="eqcut", nbins=1), "bin") == ["[1,3]"] * 3


def test_labels():
    assert interval_labels([0, 1.23456, 1.23457, 2]) == ["[0,1.23456)", "[1.23456,1.23457)", "[1.23457,2]"]
    assert interval_labels([0, 100000, 250000]) == ["[0,1e+05)", "[1e+05,2.5e+05]"]
    assert interval_labels([1, 1 + 1e-15, 2]) == ["Range_1", "Range_2"]


@pytest.mark.parametrize("lo,hi,n,want", [(0, 10, 5, [0, 2, 4, 6, 8, 10]), (1.3, 97.2, 4, [0, 20, 40, 60, 80, 100]),
                                          (-3, 3, 7, [-3, -2, -1, 0, 1, 2, 3]), (5, 5, 5, [0, 5]), (0, 0, 5, [-1, 0]),
                                          (15.57, 75.29, 5, [10, 20, 30, 40, 50, 60, 70, 80])])
def test_pretty(spark, lo, hi, n, want):
    df = spark.createDataFrame([(float(lo), float(hi), n)], "lo double, hi double, n int")
    assert with_pretty(df, F.col("lo"), F.col("hi"), F.col("n"), "p").first().p == pytest.approx(want)


@pytest.mark.parametrize("nbins,ties", [(4, 1), (7, 900), (150, 3), (2000, 1)])
def test_rank_groups_of_a_split_stratum(tiny_tasks, nbins, ties):
    rng = np.random.default_rng(2)
    xs = np.concatenate([np.full(ties, 4.0), rng.integers(0, 50, 1000 - ties).astype(float)])
    rng.shuffle(xs)
    got = numbers(run(tiny_tasks, list(xs), method="ntile", nbins=nbins))
    rank = np.empty(1000, dtype=int)
    rank[np.lexsort((np.arange(1000), xs))] = np.arange(1000)
    assert got == [float(nbins * r // 1000 + 1) for r in rank]


def test_equal_counts_of_a_split_stratum(tiny_tasks):
    rng = np.random.default_rng(4)
    xs = list(rng.normal(size=600)) + list(rng.normal(size=30))
    strat = ["big"] * 600 + ["small"] * 30
    got = run(tiny_tasks, xs, strat, method="eqcut", nbins=4).groupBy("strat").agg(F.sort_array(F.collect_set("bin_left")).alias("e"))
    for r in got.collect():
        part = np.array(xs[:600] if r.strat == "big" else xs[600:])
        assert r.e == pytest.approx([part.min(), *np.quantile(part, [0.25, 0.5, 0.75])])


@pytest.mark.parametrize("method", ["pam", "kmeans", "fisher", "jenks", "hclust", "bclust"])
def test_clusters_are_separated(spark, method):
    xs = [1, 1.1, 1.2, 5, 5.1, 5.3, 9, 9.2, 9.4, 9.5]
    got = run(spark, xs, method=method, nbins=3)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.bin, []).append(r.x)
    want = [[1, 1.1, 1.2], [5, 5.1, 5.3], [9, 9.2, 9.4, 9.5]]
    if method == "jenks":
        # A break is the upper end of its class and intervals are closed on the left.
        want = [[1, 1.1], [1.2, 5, 5.1], [5.3, 9, 9.2, 9.4, 9.5]]
    assert sorted(map(sorted, groups.values())) == want


@pytest.mark.parametrize("absolute", [False, True])
def test_best_intervals_against_all_partitions(absolute):
    rng = np.random.default_rng(8)
    for _ in range(20):
        m, k = int(rng.integers(3, 11)), int(rng.integers(1, 4))
        v, w = np.sort(rng.normal(size=m)), rng.integers(1, 5, m).astype(float)

        def cost(a, b):
            x = np.repeat(v[a:b + 1], w[a:b + 1].astype(int))
            return min(np.abs(x - c).sum() for c in x) if absolute else ((x - x.mean()) ** 2).sum()

        k = min(k, m)
        best = min(sum(cost(a, b - 1) for a, b in zip((0, *c), (*c, m))) for c in itertools.combinations(range(1, m), k - 1))
        off = v - np.average(v, weights=w)
        got, least = best_intervals(Costs({"lo": off, "hi": off, "w": w, "s": w * off, "q": w * off * off}, absolute), k)
        assert least == pytest.approx(best, abs=1e-9)
        assert len(got) == k and got[0][0] == 0 and got[-1][1] == m - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))
        assert sum(cost(a, b) for a, b in got) == pytest.approx(best, abs=1e-9)


def test_complete_linkage():
    v = np.array([0.0, 1.0, 2.5, 6.0, 6.4, 11.0])
    assert border_heights(v, v, np.ones(6), "complete").tolist() == [1.0, 2.5, 11.0, pytest.approx(0.4), 5.0]


def test_plug_in_width_of_normal_data():
    # For standard normal data the optimal width is close to 3.49 n^(-1/3).
    grid = np.linspace(-4, 4, 401)
    density = np.exp(-grid ** 2 / 2)
    counts = 10000 * density / density.sum()
    assert plug_in_width(counts, grid[1] - grid[0]) == pytest.approx(3.49 * 10000 ** (-1 / 3), rel=0.05)


@pytest.mark.parametrize("method", ["pam", "kmeans", "jenks", "fisher", "hclust", "bclust"])
def test_clusters_beyond_the_exact_table(tiny_tasks, method):
    tiny_tasks.conf.set("predcheck.clusterCells", "60")
    try:
        rng = np.random.default_rng(1)
        xs = np.concatenate([rng.normal(0, 1, 300), rng.normal(20, 1, 300), rng.normal(50, 2, 300)])
        got = run(tiny_tasks, list(xs), method=method, nbins=3).groupBy("bin").agg(F.count("x").alias("n")).collect()
        counts = sorted(r.n for r in got)
        assert counts == ([299, 300, 301] if method == "jenks" else [300, 300, 300])
    finally:
        tiny_tasks.conf.unset("predcheck.clusterCells")


def test_bad_requests(spark):
    for rule in ({"method": "nope"}, {"method": "ntile"}, {"method": "breaks"}, {"method": "centers"}, {},
                 {"method": "breaks", "breaks": [1, float("nan")]}, {"method": "ntile", "nbins": 3, "stratum": 5},
                 {"method": "ntile", "nbins": 3, "stratum": {"s": 1}, "by_strata": False}):
        with pytest.raises(ValueError):
            BinRule(**rule)
    df = frame(spark, [1, 2, 3], ["a", "a", "b"])
    partial = spark.createDataFrame([("a", 2)], "strat string, nbins int")
    with pytest.raises(ValueError, match="exactly one nbins"):
        assign_bins(df, "x", BinRule(method="ntile", nbins=partial), ["strat"], "obs_id")
    double = spark.createDataFrame([("a", 2), ("a", 3), ("b", 2)], "strat string, nbins int")
    with pytest.raises(ValueError, match="exactly one nbins"):
        assign_bins(df, "x", BinRule(method="ntile", nbins=double), ["strat"], "obs_id")
    centers = spark.createDataFrame([("a", 2.0)], "strat string, centers double")
    with pytest.raises(ValueError, match="non-numeric centers"):
        assign_bins(df, "x", BinRule(method="centers", centers=centers), ["strat"], "obs_id")
    with pytest.raises(Exception, match="one bin for each value"):
        assign_bins(df, "x", BinRule(func=lambda x, n, strat: [1], grouped=True), ["strat"], "obs_id").collect()


@pytest.mark.parametrize("method", ["pam", "kmeans", "hclust", "fisher", "jenks", "bclust", "dpih", "sd", "pretty", "equal", "quantile"])
def test_pooled_bins_are_the_same_in_every_stratum(spark, method):
    xs = list(np.random.default_rng(0).normal(size=80))
    pooled = run(spark, xs, ["a", "b"] * 40, by=(), method=method, nbins=4)
    assert numbers(pooled, "bin") == numbers(run(spark, xs, method=method, nbins=4), "bin")


def test_pooled_user_functions(spark):
    xs = [1.0, 2.0, 3.0, 10.0]
    above = run(spark, xs, by=(), func=lambda x, mean: (x > mean).cast("int"), stats={"mean": F.avg})
    assert numbers(above) == [0, 0, 0, 1]
    words = run(spark, xs, by=(), func=lambda x, n: ["low" if v < 2.5 else "high" for v in x], grouped=True)
    assert numbers(words, "bin") == ["low", "low", "high", "high"] and numbers(words) == [None] * 4


def test_ties_of_a_split_stratum_with_text_ids(tiny_tasks):
    xs = [4.0] * 300 + [5.0] * 100
    df = frame(tiny_tasks, xs).withColumn("name", F.format_string("n%05d", F.col("obs_id")))
    got = numbers(assign_bins(df, "x", BinRule(method="ntile", nbins=7), ["strat"], "name"))
    assert got == [float(7 * i // 400 + 1) for i in range(400)]


def test_missing_and_infinite_x_warn(spark):
    with pytest.warns(UserWarning, match="missing"):
        run(spark, [1, None, 3], method="ntile", nbins=2)
    with pytest.warns(UserWarning, match="non-finite"):
        run(spark, [1, float("inf"), 3], method="ntile", nbins=2)
