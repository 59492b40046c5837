import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predcheck.functions.quantiles import bracketed_quantiles, counted_quantiles, grouped_quantiles, select_ranks

# numpy's names of the definitions 1 to 9
METHODS = ["inverted_cdf", "averaged_inverted_cdf", "closest_observation", "interpolated_inverted_cdf", "hazen", "weibull",
           "linear", "median_unbiased", "normal_unbiased"]
PROBS = [0.0, 0.05, 0.3, 0.5, 0.77, 0.95, 1.0]


def groups(seed=3):
    rng = np.random.default_rng(seed)
    out = {f"g{n}": np.round(rng.normal(size=n), 1) for n in (1, 2, 3, 4, 5, 8, 9, 25)}
    return {k: v.astype(float) for k, v in out.items()}


@pytest.mark.parametrize("qtype", range(1, 10))
def test_all_types_match_numpy(spark, qtype):
    data = groups()
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    got = {r.k: r for r in grouped_quantiles(spark.createDataFrame(rows, "k string, y double"), ["k"], "y", PROBS, qtype).collect()}
    for k, vs in data.items():
        assert got[k].n == len(vs)
        assert np.allclose(got[k].q, np.quantile(vs, PROBS, method=METHODS[qtype - 1]), atol=1e-12), k


def test_hand_cases(spark):
    rows = [("a", v) for v in (1.0, 2.0, 4.0, 8.0)] + [("b", v) for v in (float("-inf"), float("-inf"), 3.0, 5.0, 9.0)] + [("c", None), (None, 6.0)]
    df = spark.createDataFrame(rows, "k string, y double")
    got = {r.k: r.q for r in grouped_quantiles(df, ["k"], "y", [0.05, 0.3, 0.5, 0.95]).collect()}
    assert got["a"] == pytest.approx([1.15, 1.9, 3.0, 7.4])
    assert got["b"][1] == float("-inf") and got["b"][2] == 3.0
    assert got["c"] == [None] * 4
    assert got[None] == [6.0] * 4


@pytest.mark.parametrize("qtype", [1, 6, 7])
def test_large_groups_are_split_and_stay_exact(tiny_tasks, qtype):
    rng = np.random.default_rng(5)
    values = {"tied": np.where(rng.random(3000) < 0.5, 0.0, rng.normal(size=3000)), "constant": np.full(500, 2.5),
              "heavy": np.exp(rng.normal(0, 9, 2500)), "small": rng.normal(size=30)}
    pdf = pd.DataFrame([(k, float(v)) for k, vs in values.items() for v in vs], columns=["k", "y"])
    got = {r.k: r for r in grouped_quantiles(tiny_tasks.createDataFrame(pdf).repartition(5), ["k"], "y", PROBS, qtype,
                                              extra=[F.max("y").alias("top")]).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k].n == len(vs) and got[k].top == vs.max()
        assert np.allclose(got[k].q, np.quantile(vs, PROBS, method=METHODS[qtype - 1]), rtol=1e-12)


def test_split_without_keys_and_with_infinities(tiny_tasks):
    values = [float("-inf")] * 100 + [float(i) for i in range(300)]
    df = tiny_tasks.createDataFrame([(v,) for v in values], "y double")
    q = grouped_quantiles(df, [], "y", [0.1, 0.5, 0.9]).first().q
    assert q[0] == float("-inf") and q[1] == pytest.approx(np.median(values)) and q[2] == pytest.approx(np.quantile(values, 0.9))


def test_recursion_and_shared_split_points(spark):
    spark.conf.set("predcheck.splitRows", "3")
    try:
        rng = np.random.default_rng(9)
        pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 4000), "rep": np.tile([1, 2], 4000), "y": rng.integers(0, 3000, 8000)})
        df = spark.createDataFrame(pdf)
        wants = spark.createDataFrame([(k, i, r) for k in "ab" for i in (1, 2) for r in (1, 777, 1000, 2000)], "k string, rep long, r long")
        got = select_ranks(df, ["k", "rep"], "y", wants, 2000, ["k"]).collect()
        assert len(got) == 16
        for r in got:
            assert r.v == np.sort(pdf[(pdf.k == r.k) & (pdf.rep == r.rep)].y.to_numpy())[r.r - 1]
    finally:
        spark.conf.unset("predcheck.splitRows")


def replicated(shifts, n=400, seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for rep, shift in enumerate(shifts):
        y = np.where(rng.random(n) < 0.2, 0.0, np.round(rng.normal(size=n), 2)) + shift
        rows += [("a", rep, float(v)) for v in y] + [("b", rep, None)] + [("c", rep, float("inf") if i % 2 else float(i)) for i in range(6)]
    return pd.DataFrame(rows, columns=["k", "repl", "y"])


@pytest.mark.parametrize("qtype", [2, 7])
@pytest.mark.parametrize("far", [0.0, 50.0])
@pytest.mark.parametrize("task_rows", ["4000000", "30"])
def test_brackets_are_exact_even_when_the_pilots_mislead(spark, qtype, far, task_rows):
    # Replicates 4 and 7 lie far from the pilots when ``far`` is not zero, so their quantiles miss the brackets.
    pdf = replicated([0.0] * 4 + [far] + [0.01] * 2 + [-far] + [0.02] * 2)
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None)))
    spark.conf.set("predcheck.splitRows", task_rows)
    try:
        got = bracketed_quantiles(df, ["k"], "repl", [0, 1, 2, 3], "y", [0.05, 0.5, 0.95], qtype).collect()
    finally:
        spark.conf.unset("predcheck.splitRows")
    assert len(got) == 30
    for r in got:
        part = pdf[(pdf.k == r.k) & (pdf.repl == r.repl)].y.to_numpy()
        if r.k == "b":
            assert r.n == 0 and r.q == [None] * 3
        elif r.k == "a":
            assert np.allclose(r.q, np.quantile(part, [0.05, 0.5, 0.95], method=METHODS[qtype - 1]), atol=1e-12)
        else:
            assert r.q[0] < 2 and r.q[2] == float("inf")


def test_brackets_in_the_pipeline(spark, monkeypatch):
    import predcheck as pk
    import predcheck.plans.spec as spec
    rng = np.random.default_rng(3)
    obs = spark.createDataFrame([(i, "ab"[i % 2], float(i % 7), float(rng.normal())) for i in range(300)], "obs_id long, s string, x double, y double")
    sim = obs.select("obs_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("repl"), "y") \
        .withColumn("y", F.col("y") + F.col("repl") / 100 + (F.col("obs_id") * F.col("repl") % 13) / 13)
    v = pk.observed(obs, "x", "y", id="obs_id").simulated(sim, "y").stratify("~ s").binning(method="ntile", nbins=2).statistics()
    plain = v.stats.collect()
    monkeypatch.setattr(spec, "brackets_pay", lambda *a: True)
    assert v.stats.collect() == plain


@pytest.mark.parametrize("limit", [None, 30])
@pytest.mark.parametrize("qtype", [1, 2, 6, 7])
def test_counted_quantiles(spark, qtype, limit):
    """Ties, missing and infinite values, a group that no pilot has, an empty group, and cells too large for a task."""
    rng = np.random.default_rng(qtype)
    rows = []
    for g in range(3):
        for r in range(1, 7):
            for i in range(400 if (g, r) != (2, 6) else 3):
                x = float(rng.choice([1.0, 2.0, float("-inf"), float("inf")])) if rng.random() < 0.3 else float(rng.normal(g, r))
                rows.append((g, r, None if rng.random() < 0.1 else x, bool(i % 3)))
    rows += [(7, 5, float(i), None) for i in range(50)] + [(8, 5, None, True)]
    df = spark.createDataFrame(rows, "g int, rep int, v double, f boolean").repartition(5)
    got = counted_quantiles(df, ["g"], "rep", [1, 2, 3], "v", [0.0, 0.05, 0.5, 0.95, 1.0], qtype, {"flagged": F.count_if("f")}, limit)
    want = grouped_quantiles(df, ["g", "rep"], "v", [0.0, 0.05, 0.5, 0.95, 1.0], qtype, extra=[F.count_if("f").alias("flagged")])
    read = lambda d: {(r.g, r.rep): (r.n, r.flagged, r.q) for r in d.collect()}
    assert read(got) == read(want) and len(read(got)) == 20


def test_counting_inside_a_check(spark, monkeypatch):
    """The same tables with and without the counting pass, which then shuffles few values."""
    from predcheck.functions import quantiles
    import predcheck as pk
    obs = spark.range(6000).select(F.col("id").alias("i"), (F.col("id") % 10).cast("double").alias("t"), (F.col("id") * 7919 % 1000).cast("double").alias("y"))
    sim = obs.select("i", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("repl"), "y").select("i", "repl", (F.col("y") + (F.col("i") * 31 * F.col("repl")) % 97).alias("y"))
    tables = []
    for most in (quantiles.MOST_COUNTERS, 0):
        spark.conf.set(quantiles.COUNTING_CONF, "true")
        monkeypatch.setattr(quantiles, "MOST_COUNTERS", most)
        v = pk.observed(obs, "t", "y", id="i", lloq=100.0).simulated(sim, "y").binning(method="ntile", nbins=2).statistics()
        assert quantiles.counting_pays(v.sizes["rows"], v.sizes["bins"], 24) == bool(most)
        tables.append(([tuple(r) for r in v.stats.collect()], [tuple(r) for r in v.pctblq.collect()]))
        spark.conf.unset(quantiles.COUNTING_CONF)
    assert tables[0] == tables[1]
