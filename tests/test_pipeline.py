import datetime
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import predcheck as pk
from predcheck.operators.report import back_transform, facets, floor_values, interval_width
from predcheck.sources.readers import read_table, write_table

INF = float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, strat string, x double, y double, pred double, blq boolean, lloq double")


def small(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    return table(spark, [(i, "ab"[i % 2], float(i // 6), float(rng.lognormal()), float(1 + rng.random()), False, 0.1) for i in range(n)])


def replicates(spark, obs, count=4):
    sim = obs.select("obs_id", "y", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("repl"))
    return sim.withColumn("ys", F.col("y") * (0.5 + (F.col("obs_id") * 7 + F.col("repl") * 5) % 11 / 10.0))


def check(spark, obs, sim):
    return pk.observed(obs, "x", "y", id="obs_id", pred="pred", blq="blq", lloq="lloq").simulated(sim, "ys").stratify("~ strat")


def result(df):
    return [tuple(r) for r in df.collect()]


def test_identity_replicates_give_the_observed_values(spark):
    obs = small(spark)
    sim = replicates(spark, obs).withColumn("ys", F.col("y"))
    stats = check(spark, obs, sim).binning(method="ntile", nbins=3).statistics().stats.collect()
    assert len(stats) == 18
    for r in stats:
        assert r.y == pytest.approx(r.lo) == pytest.approx(r.md) == pytest.approx(r.hi)


def test_interval_order_and_independence_of_partitioning(spark):
    obs = small(spark)
    sim = replicates(spark, obs)
    one = check(spark, obs, sim).binning(method="eqcut", nbins=3).predcorrect().statistics()
    two = check(spark, obs.repartition(7), sim.repartition(5, "repl")).binning(method="eqcut", nbins=3).predcorrect().statistics()
    assert result(one.stats) == result(two.stats)
    assert all(r.lo <= r.md <= r.hi for r in one.stats.collect())
    info = one.bininfo().orderBy("strat", "xmin").collect()
    assert sum(r.nobs for r in info) == 60
    assert all(r.xleft <= r.xmin <= r.xmax <= r.xright for r in info)
    assert all(a.xright == b.xleft for a, b in zip(info, info[1:]) if a.strat == b.strat)


@pytest.mark.parametrize("by_strata", [True, False])
def test_split_groups_give_the_same_results(spark, by_strata):
    obs = small(spark, 400).withColumn("blq", F.col("y") < 0.6).withColumn("lloq", F.lit(0.6))
    sim = replicates(spark, obs)

    def results():
        v = check(spark, obs, sim).binning(method="ntile", nbins=3, by_strata=by_strata).predcorrect().statistics()
        return [[[None if c is None else c if isinstance(c, str) else round(c, 9) for c in r] for r in t.collect()]
                for t in (v.stats, v.pctblq, v.bininfo().orderBy("strat", "xmin"))]

    plain = results()
    spark.conf.set("predcheck.splitRows", "25")
    try:
        assert results() == plain
    finally:
        spark.conf.unset("predcheck.splitRows")


def test_neighbours_of_very_many_bins(spark):
    obs = small(spark)
    v = pk.observed(obs, "x", "y", id="obs_id").binning("y").update(strat_cols=())
    plain = result(v.bininfo().orderBy("xmin"))
    spark.conf.set("predcheck.splitRows", "10")
    try:
        assert result(pk.observed(obs, "x", "y", id="obs_id").binning("y").bininfo().orderBy("xmin")) is not None
        got = result(pk.observed(obs, "y", "y", id="obs_id").binning("y").bininfo().orderBy("xmin"))
    finally:
        spark.conf.unset("predcheck.splitRows")
    assert got == result(pk.observed(obs, "y", "y", id="obs_id").binning("y").bininfo().orderBy("xmin"))
    assert len(plain) == 60


def test_missing_and_special_values(spark):
    nan = float("nan")
    obs = table(spark, [(0, "a", 1.0, nan, 0.0, False, 0.0), (1, "a", 1.0, 2.0, 2.0, False, 0.0), (2, "a", 1.0, 3.0, 4.0, None, 0.0),
                        (3, "b", 1.0, 5.0, None, True, 9.0), (4, "b", 1.0, 6.0, 1.0, False, 9.0), (5, "c", 1.0, 4.0, 0.0, False, 1.0)])
    sim = replicates(spark, obs).withColumn("ys", F.col("y"))
    v = check(spark, obs, sim).binning("x").predcorrect().statistics([0.5])
    ypc = {r.obs_id: r.ypc for r in v.corrected_obs().collect()}
    # Bin a: median prediction 2. A zero prediction gives an infinite factor; a missing y stays missing.
    assert ypc[0] is None and ypc[1] == 2.0 and ypc[2] == 1.5
    # Bin b has a missing prediction, so nothing in it can be corrected. Bin c is 0/0.
    assert ypc[3] is None and ypc[4] is None and ypc[5] is None
    stats = {r.strat: r for r in v.stats.collect()}
    assert stats["a"].y == 2.0 and stats["b"].y is None and stats["c"].y is None
    pct = {r.strat: r for r in v.pctblq.collect()}
    # A missing flag makes the observed share missing; simulated flags come from the raw values.
    assert pct["a"].y is None and pct["b"].y == 50.0 and pct["b"].md == 100.0
    plain = {r.strat: r for r in v.nopredcorrect().statistics([0.5]).stats.collect()}
    # Censored 5 and plain 6: the median falls between -Inf and 6 and is missing.
    assert plain["b"].y is None and plain["a"].y == 2.0


def test_zero_prediction_gives_infinity(spark):
    obs = table(spark, [(0, "a", 1.0, -2.0, 0.0, False, 0.0), (1, "a", 1.0, 2.0, 3.0, False, 0.0), (2, "a", 1.0, 2.0, 3.0, False, 0.0)])
    v = pk.observed(obs, "x", "y", id="obs_id", pred="pred").binning("x").predcorrect()
    assert {r.obs_id: r.ypc for r in v.corrected_obs().collect()} == {0: -INF, 1: 2.0, 2: 2.0}
    logged = v.predcorrect(log=True).corrected_obs().collect()
    assert {r.obs_id: r.ypc for r in logged} == {0: 1.0, 1: 2.0, 2: 2.0}


def test_constant_prediction_changes_nothing(spark):
    obs = small(spark).withColumn("pred", F.lit(3.0))
    v = check(spark, obs, replicates(spark, obs)).binning(method="ntile", nbins=2)
    assert result(v.predcorrect().statistics().stats) == result(v.statistics().stats)


def test_no_percent_table_without_censored_values(spark):
    obs = small(spark)
    assert check(spark, obs, replicates(spark, obs)).binning("x").statistics().pctblq is None


def test_all_values_censored(spark):
    obs = small(spark).withColumn("blq", F.lit(True))
    v = check(spark, obs, replicates(spark, obs)).binning(method="ntile", nbins=2).statistics()
    assert all(r.y is None and r.md is not None for r in v.stats.collect())
    assert all(r.y == 100.0 for r in v.pctblq.collect())


def test_steps_are_checked(spark):
    obs = small(spark)
    v = check(spark, obs, replicates(spark, obs))
    for call in (lambda: v.statistics(), lambda: v.predcorrect(), lambda: v.stratify("strat"), lambda: v.stratify(". ~ ."),
                 lambda: v.stratify(cols=[("xbin", F.lit(1))]), lambda: v.binning("x", xbin="nothing"),
                 lambda: v.binning("x").stratify("~ strat").statistics(), lambda: v.binning(), lambda: v.bininfo(),
                 lambda: pk.observed(obs, "x", "y"), lambda: pk.observed(obs, "x", id="obs_id"),
                 lambda: pk.observed(obs, "x", "y", id="obs_id").binning("x").statistics(),
                 lambda: pk.observed(obs, "x", "y", id="obs_id").binning("x").predcorrect(),
                 lambda: pk.observed(obs, "x", "y", id="obs_id").binning(method="ntile", nbins=2, stratum={"strat": "a"}),
                 lambda: check(spark, obs.withColumn("strat", F.lit(None).cast("string")), replicates(spark, obs)).binning("x").statistics()):
        with pytest.raises(ValueError):
            call()


def test_missing_bins_warn(spark):
    obs = small(spark)
    v = check(spark, obs, replicates(spark, obs)).binning(method="ntile", nbins=2, stratum={"strat": "a"})
    with pytest.warns(UserWarning, match="no bin"):
        out = v.statistics()
    assert {(r.strat, r.bin) for r in out.stats.collect()} == {("a", "1"), ("a", "2"), ("b", None)}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        v.binning(method="ntile", nbins=3, stratum=spark.createDataFrame([("b",)], "strat string")).statistics()


def test_update_and_removed_fields(spark):
    v = check(spark, small(spark), replicates(spark, small(spark)))
    assert v.update(pred=None).pred is None and v.update(conf_level=0.5).conf_level == 0.5
    with pytest.raises(TypeError):
        v.update(nothing=1)


def test_position_mode(spark):
    obs = small(spark, 10)
    sim = replicates(spark, obs, 3).select(F.col("obs_id").alias("k"), "repl", "ys")
    v = pk.observed(obs, "x", "y", order=["x", "obs_id"]).simulated(sim, "ys", order=["repl", "k"])
    by_key = {(r.obs_id, r.repl): r.y for r in v.sim.collect()}
    assert by_key == {(r.k, r.repl): r.ys for r in sim.collect()}
    with pytest.raises(ValueError, match="multiple"):
        pk.observed(obs, "x", "y", order=["obs_id"]).simulated(sim.filter("not (k = 3 and repl = 2)"), "ys", order=["repl", "k"])


def test_order_check(spark):
    obs = spark.createDataFrame([(i, i * 0.5) for i in range(20)], "ID long, TIME double").repartition(3)
    sim = obs.select(F.col("ID").cast("double").alias("ID"), "TIME", F.explode(F.array(F.lit(1), F.lit(2))).alias("r"))
    order = (["ID"], ["r", "ID"])
    assert pk.check_order(obs, sim, *order) == 2
    assert pk.check_order(obs, sim.withColumn("TIME", F.col("TIME") + 0.9e-5), *order) == 2
    with pytest.raises(ValueError, match="Time"):
        pk.check_order(obs, sim.withColumn("TIME", F.col("TIME") + 1.1e-5), *order)
    with pytest.raises(ValueError, match="ID"):
        pk.check_order(obs, sim.withColumn("ID", F.col("ID") + 1), *order)
    with pytest.raises(ValueError, match="multiple"):
        pk.check_order(obs, sim.filter("ID > 0"), *order)
    with pytest.raises(ValueError, match="ID"):
        pk.check_order(obs, sim.withColumn("ID", F.col("ID").cast("long").cast("string")), ["ID"], ["r", "TIME"])


def test_dense_index_over_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(11)
    assert all(r.k == r.row_index for r in pk.dense_index(df, ["k"]).collect())


def test_several_id_columns(spark):
    obs = small(spark).withColumn("part", F.col("obs_id") % 3)
    sim = replicates(spark, obs).withColumn("part", F.col("obs_id") % 3)
    v = pk.observed(obs, "x", "y", id=["obs_id", "part"]).simulated(sim, "ys").binning(method="ntile", nbins=3).statistics()
    w = pk.observed(obs, "x", "y", id="obs_id").simulated(sim, "ys").binning(method="ntile", nbins=3).statistics()
    assert result(v.stats) == result(w.stats)


def test_reports_leave_missing_values(spark):
    df = spark.createDataFrame([(0.0, None), (2.0, -9.0)], "y double, lo double")
    assert result(floor_values(df, 1.0, ["y", "lo"])) == [(1.0, None), (2.0, 1.0)]
    assert result(back_transform(df, ["y", "lo"]))[0] == (1.0, None)
    v = pk.observed(small(spark), "x", "y", id="obs_id").update(conf_level=0.9)
    assert interval_width(v) == 90


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5, datetime.date(2020, 1, 1))], "id int, s string, y double, d date")
    write_table(df, str(tmp_path / "t.csv"), "csv")
    write_table(df, str(tmp_path / "t"), partition_by=("s",))
    assert read_table(spark, str(tmp_path / "t.csv")).first().y == 2.5
    assert read_table(spark, str(tmp_path / "t")).first().id == 1
    assert math.isclose(read_table(spark, str(tmp_path / "t.csv"), schema="id int, s string, y double, d date").first().y, 2.5)


def test_results_do_not_depend_on_broadcasts(spark):
    obs = small(spark, 300).withColumn("blq", F.col("y") < 0.6).withColumn("lloq", F.lit(0.6))
    sim = replicates(spark, obs)

    def tables():
        v = check(spark, obs, sim).binning(method="eqcut", nbins=3).predcorrect().statistics()
        return v, result(v.stats), result(v.pctblq)

    plain = tables()
    spark.conf.set("predcheck.broadcastBytes", "0")
    try:
        assert tables()[1:] == plain[1:]
    finally:
        spark.conf.unset("predcheck.broadcastBytes")


@pytest.mark.parametrize("corrected, qtype", [(False, 7), (True, 2)])
def test_stored_quantiles_of_replicates(spark, tmp_path, corrected, qtype):
    """Added and changed replicates are computed, known ones read; results are those of a check without a store."""
    obs = small(spark).withColumn("blq", F.col("y") < 0.6).withColumn("lloq", F.lit(0.6))
    store = str(tmp_path / "store")

    def stated(sim, store=None):
        v = check(spark, obs, sim).binning("x")
        return (v.predcorrect() if corrected else v).statistics(quantile_type=qtype, store=store)

    def marks():
        return sum(r["n"] for r in spark.read.parquet(*[str(p) for p in (tmp_path / "store").iterdir()]).groupBy().agg(F.count_distinct("repl", "mark").alias("n")).collect())

    all_rows = replicates(spark, obs, 9)
    changed = all_rows.withColumn("ys", F.when(F.col("repl") == 2, F.col("ys") * 1.5).otherwise(F.col("ys")))
    for sim, held in ((all_rows.filter("repl <= 4"), 4), (all_rows, 9), (changed, 10), (all_rows.filter("repl > 6"), 10)):
        got, want = stated(sim, store), stated(sim)
        assert result(got.stats) == result(want.stats) and result(got.pctblq) == result(want.pctblq)
        assert marks() == held
    other = check(spark, obs, all_rows).binning(method="ntile", nbins=3).statistics(store=store)
    assert result(other.stats) == result(check(spark, obs, all_rows).binning(method="ntile", nbins=3).statistics().stats)
    assert len(list((tmp_path / "store").iterdir())) == 2


def test_facets_of_many_strata(spark):
    """Strata beyond the number that one task orders get the same places."""
    obs = small(spark).withColumn("part", F.when(F.col("obs_id") % 3 > 0, F.col("obs_id") % 3))

    def places():
        for formula in ("~ strat + part", "strat ~ part", "strat ~ ."):
            yield sorted(result(facets(pk.observed(obs, "x", "y", id="obs_id").stratify(formula))), key=repr)

    want = list(places())
    spark.conf.set("predcheck.splitRows", "1")
    try:
        assert list(places()) == want and sorted(r[-1] for r in want[0]) == [1, 2, 3, 4, 5, 6]
    finally:
        spark.conf.unset("predcheck.splitRows")
