"""Mergeable functions, fitted strata, stored replicates and lookups in long arrays against plain Python."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import predcheck as pk
from predcheck.functions.breaks import closest, interval
from predcheck.operators import states
from predcheck.operators.strata import fitted_term, split_formula


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 3 == 0], rng.choice([None, float("nan")]) if i % 50 == 7 else rng.uniform(-5, 40)) for i in range(3000)]
    rows += [(9000 + i, "only missing", None) for i in range(3)]
    return spark.createDataFrame(rows, "id long, s string, x double").repartition(40), rows


KEPT = pk.Mergeable(list, lambda s, x: s + x.tolist(), lambda a, b: a + b, lambda s, group: sorted(s))


@pytest.mark.parametrize("fan,held", [(32, 4096), (3, 1)])
def test_states_see_every_value_once(data, monkeypatch, fan, held):
    from pyspark.sql import types as T
    monkeypatch.setattr(states, "FAN", fan)
    monkeypatch.setattr(states, "HELD", held)
    df, rows = data
    got = {r.s: r.result for r in states.merged(df, ["s"], "x", KEPT, T.ArrayType(T.DoubleType())).collect()}
    want = {s: sorted(x for _, t, x in rows if t == s and x is not None and x == x) for s in ("a", "b", "only missing")}
    assert got == want
    assert states.merged(df.limit(0), ["s"], "x", KEPT, T.ArrayType(T.DoubleType())).count() == 0


def test_bins_from_states(spark, data):
    """The function also gets the stratum; pooled and by stratum; no limit on the number of values."""
    df, rows = data
    thirds = pk.Mergeable(list, KEPT.add, KEPT.merge, lambda s, group: [sorted(s)[len(s) // 3]] if group.get("s") != "b" else [0.0, 10.0])
    spark.conf.set("predcheck.splitRows", "50")
    try:
        whole = df.filter("s <> 'only missing'")
        got = pk.assign_bins(whole, "x", pk.BinRule(func=thirds), ["s"]).collect()
        pooled = pk.assign_bins(whole, "x", pk.BinRule(func=thirds), []).collect()
    finally:
        spark.conf.unset("predcheck.splitRows")

    def number(x, cuts, values):
        edges = sorted({*cuts, min(*values, *cuts), max(*values, *cuts)})
        return max(1, min(bisect.bisect_right(edges, x), len(edges) - 1))

    by = {s: [x for _, t, x in rows if t == s and x is not None and x == x] for s in "ab"}
    cuts = {"a": [sorted(by["a"])[len(by["a"]) // 3]], "b": [0.0, 10.0]}
    every = by["a"] + by["b"]
    for r in got:
        assert r.bin_num == (None if r.x is None or r.x != r.x else number(r.x, cuts[r.s], by[r.s]))
    for r in pooled:
        assert r.bin_num == (None if r.x is None or r.x != r.x else number(r.x, [sorted(every)[len(every) // 3]], every))
    with pytest.raises(ValueError, match="no breaks"):
        pk.fit_bins(whole.withColumn("__x", F.col("x")), pk.BinRule(func=pk.Mergeable(list, KEPT.add, KEPT.merge, lambda s, group: [])), ["s"])
    with pytest.raises(ValueError, match="Mergeable takes"):
        pk.BinRule(func=thirds, grouped=True)


@pytest.mark.parametrize("size", [1, 2, 24, 25, 1000])
def test_lookups_in_arrays(spark, size):
    rng = random.Random(size)
    values = sorted(rng.sample(range(-3000, 3000), size))
    xs = [*map(float, values), *(v + 0.5 for v in values), -1e9, 1e9, 1e300, None]
    row = spark.createDataFrame([(x, [float(v) for v in values]) for x in xs], "x double, a array<double>")
    for r in row.select("x", interval(F.col("x"), F.col("a")).alias("l"), interval(F.col("x"), F.col("a"), True).alias("r"), closest(F.col("x"), F.col("a")).alias("c")).collect():
        if r.x is None:
            assert r.l is r.r is r.c is None
            continue
        assert r.l == max(1, min(bisect.bisect_right(values, r.x), size - 1)) and r.r == max(1, min(bisect.bisect_left(values, r.x), size - 1))
        assert r.c == min(values, key=lambda v: (abs(r.x - v), v))


def test_fitted_terms(spark, data):
    df, rows = data
    xs = sorted(x for _, _, x in rows if x is not None and x == x)
    name, level = fitted_term("cut(x * 2, 4)", df)
    assert name == "cut_x_2_4"
    counts = [r["count"] for r in df.filter(F.col("x").isNotNull() & ~F.isnan("x")).select(level.alias("v")).groupBy("v").count().collect()]
    lo, hi = 2 * xs[0], 2 * xs[-1]
    edges = [lo + (hi - lo) * i / 4 for i in range(1, 4)]
    assert sorted(counts) == sorted(np.bincount([bisect.bisect_left(edges, 2 * x) for x in xs]).tolist())
    name, level = fitted_term("third = quantiles(x, 3)", df)
    sizes = [r["count"] for r in df.filter("x = x").select(level.alias("v")).filter("v is not null").groupBy("v").count().collect()]
    assert name == "third" and sum(sizes) == len(xs) and max(sizes) - min(sizes) <= 1
    _, level = fitted_term("cut(x, [0, 10, 20.5])", df)
    assert {r.v for r in df.select(level.alias("v")).distinct().collect()} == {None, "(0,10]", "(10,20.5]"}
    assert fitted_term("x", df) is None and split_formula("cut(a + b, 2) + c ~ f = cut(d, [1, 2])") == (["cut(a + b, 2)", "c"], ["f = cut(d, [1, 2])"], True)
    for bad, why in (("cut(x, 1)", "at least 2"), ("cut(x)", "takes an expression"), ("quantiles(x, [1, 2])", "number of intervals"), ("cut(1, 2)", "nothing to cut")):
        with pytest.raises(ValueError, match=why):
            fitted_term(bad, df)
    with pytest.raises(ValueError, match="not closed"):
        split_formula("~ cut(x, 2")


def test_stored_replicates_are_not_shuffled(spark, tmp_path):
    obs = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 9).cast("double").alias("t"), F.lit(1.0).alias("y"))
    sim = obs.select("k", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("repl"), (F.col("t") + F.rand(1)).alias("v"))
    sim = spark.createDataFrame(sim.toArrow())
    stored = pk.store_replicates(sim, "stored_replicates", "v", "k", buckets=4, path=str(tmp_path / "r"))
    spark.conf.set("predcheck.broadcastBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, kept = (pk.observed(obs, "t", "y", id="k").simulated(s, "v").binning(method="ntile", nbins=3).statistics() for s in (sim, stored))
        assert [tuple(r) for r in kept.stats.collect()] == [tuple(r) for r in plain.stats.collect()]
        plan = kept._grouped_sim()._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("stored_replicates") - 400:plan.index("stored_replicates")]
        assert "Bucketed: true" in plan and "Exchange" not in side
    finally:
        spark.conf.unset("predcheck.broadcastBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_replicates")
