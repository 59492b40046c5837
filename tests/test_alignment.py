"""What the check refuses, and what its steps drop."""

import random

import pytest
from pyspark.sql import functions as F

import predcheck as pk
from predcheck.operators import align


@pytest.fixture(scope="module")
def obs(spark):
    return spark.range(40).select(F.col("id").alias("i"), (F.col("id") % 8).cast("double").alias("t"), (F.col("id") * 3 % 17).cast("double").alias("y"),
                                  F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"))


@pytest.fixture(scope="module")
def sim(obs):
    return obs.select("i", F.explode(F.array(*[F.lit(r) for r in range(1, 7)])).alias("repl"), (F.col("y") + F.col("repl")).alias("y"))


def check(obs):
    return pk.observed(obs, "t", "y", id="i", lloq=4.0).stratify("~ s")


def test_aligned(obs, sim):
    v = check(obs).simulated(sim, "y").binning(method="ntile", nbins=2)
    assert v.statistics().stats.count() and all(r.aligned for r in v.alignment().collect())
    assert v.summary().first().replicates == 6


@pytest.mark.parametrize("broken", [
    lambda s: s.withColumn("i", F.when(F.col("repl") == 3, F.col("i") + 1000).otherwise(F.col("i"))),
    lambda s: s.filter("not (repl = 2 and i = 5)"),
    lambda s: s.unionByName(s.filter("repl = 4 and i = 1")),
    lambda s: s.withColumn("i", F.when((F.col("repl") == 5) & (F.col("i") == 0), 1).otherwise(F.col("i")))])
def test_misaligned(obs, sim, broken):
    v = check(obs).simulated(broken(sim), "y").binning(method="ntile", nbins=2)
    with pytest.raises(ValueError, match="1 replicates"):
        v.statistics()
    assert v.update(check=False).statistics().stats.count()


def test_repeated_observations(obs, sim):
    twice = check(obs.unionByName(obs)).simulated(sim, "y").binning(breaks=[2, 5])
    with pytest.raises(ValueError, match="exactly once"):
        twice.statistics()


def test_filtering_drops_bins_and_summary_counts_replicates(obs, sim):
    v = check(obs).simulated(sim, "y").binning(method="ntile", nbins=3)
    dropped = v.filter_blq()
    with pytest.raises(ValueError, match="bins"):
        dropped.statistics()
    again = dropped.binning(method="ntile", nbins=3)
    sizes = [r.nobs for r in again.bininfo().collect()]
    assert max(sizes) - min(sizes) <= 1 and again.summary().first().replicates == 6
    assert not again.censoring(lloq=6.0).layers


def test_censoring_keeps_the_flag(obs):
    kept = check(obs).censoring(lloq=9.0).obs().collect()
    assert all(r.blq == (r.y < 4) and r.lloq == 9 for r in kept)


def test_missing_strata(obs):
    holes = obs.withColumn("s", F.when(F.col("i") > 5, F.col("s")))
    with pytest.raises(ValueError, match="missing values"):
        check(holes).binning(method="ntile", nbins=2).bininfo()


def test_numeric_xbin_over_breaks(obs):
    v = check(obs).binning(breaks=[3, 6]).binning(xbin=F.col("t") * 10, stratum={"s": "a"})
    got = {(r.s, r.xbin) for r in v.bins().collect()}
    assert {x for s, x in got if s == "a"} == {0, 20, 40, 60} and {x for s, x in got if s == "b"} == {10, 30, 70}


def test_large_ids(spark):
    a = spark.createDataFrame([(2**53, 1.0)], "id long, t double")
    b = spark.createDataFrame([(2**53 + 1, 1.0)], "id long, t double")
    with pytest.raises(ValueError, match="ID"):
        pk.check_order(a, b, ["id"], ["id"])


def test_data_of_a_step(obs):
    other = obs.select("i", (F.col("i") % 3).cast("string").alias("third"), F.lit(2.0).alias("pred2"))
    v = pk.observed(obs, "t", "y", id="i").stratify("~ third", data=other).binning(method="ntile", nbins=2).predcorrect("pred2", data=other)
    assert v.corrected_obs().filter("third is null or ypc is null").count() == 0
    with pytest.raises(ValueError, match="data="):
        pk.observed(obs, "t", "y", order=["i"]).stratify("~ third", data=other)


def test_pretty_options(obs):
    rows = obs.select(F.col("y").alias("__x"), F.col("i").alias("__id"))

    def intervals(**options):
        model = pk.fit_bins(rows, pk.BinRule(method="pretty", nbins=3, options=options))
        return len(model.table.first()["__cuts"]) - 1
    assert intervals(min_n=12) >= 12 > intervals()


def test_sort_merge_free_join(spark, obs, sim):
    """Beyond the broadcast limit the replicates are hashed, not sorted, and the result is the same."""
    v = check(obs).simulated(sim, "y").binning(method="ntile", nbins=2)
    want = v.statistics().stats.collect()
    spark.conf.set("predcheck.broadcastBytes", "0")
    try:
        again = check(obs).simulated(sim, "y").binning(method="ntile", nbins=2).statistics()
        assert again.stats.collect() == want
        assert "ShuffledHashJoin" in again._grouped_sim()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("predcheck.broadcastBytes")


def _in_files(spark, path, rows, files, format="parquet"):
    """Rows in the given order, in some files whose paths are in order, each of several row groups or lines."""
    for i in range(files):
        part = rows[i * len(rows) // files:(i + 1) * len(rows) // files]
        frame = spark.createDataFrame(part, "k long, v double").coalesce(1)
        writer = frame.write.option("parquet.block.size", "2000").option("header", True).option("maxRecordsPerFile", 0)
        writer.format(format).mode("append").save(f"{path}/f={i:03d}")
    reader = spark.read.option("header", True).schema("k long, v double")
    return reader.format(format).load([f"{path}/f={i:03d}" for i in range(files)])


@pytest.mark.parametrize("format,kept,files", [("parquet", "true", 5), ("parquet", "k % 3 <> 0", 5), ("csv", "true", 4), ("csv", "k % 7 < 4", 1)])
def test_positions_from_files(spark, tmp_path, format, kept, files):
    """With and without a filter, with and without row numbers in the format, however the files are cut into tasks."""
    rng = random.Random(files)
    rows = [(k, k / 2) for k in rng.sample(range(10_000), 3000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = _in_files(spark, str(tmp_path), rows, files, format).filter(kept)
        placed, n = align.file_index(df.withColumn("w", F.col("v") * 2))
        got = [r.k for r in placed.orderBy("row_index").collect()]
        assert placed.select("row_index").distinct().count() == n and sorted(r.row_index for r in placed.collect()) == list(range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    keep = {"true": lambda k: True, "k % 3 <> 0": lambda k: k % 3, "k % 7 < 4": lambda k: k % 7 < 4}[kept]
    assert got == [k for k, _ in rows if keep(k)] and set(placed.columns) == {"k", "v", "w", "row_index"}
    if (format, kept) == ("parquet", "true"):
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_check_in_the_order_of_files(spark, tmp_path):
    """Same intervals as by an order column; the two tables are cut into files differently."""
    obs = [(i, float(i % 17)) for i in range(200)]
    sim = [(r * 200 + i, i % 17 + r / 10) for r in range(4) for i in range(200)]
    o, s = _in_files(spark, str(tmp_path / "o"), obs, 1), _in_files(spark, str(tmp_path / "s"), sim, 3)
    tables = []
    for orders in ("files", "files"), (["k"], ["k"]):
        v = pk.observed(o, "k", "v", order=orders[0]).simulated(s, "v", order=orders[1]).binning(method="ntile", nbins=4)
        tables.append([tuple(r) for r in v.statistics().stats.collect()])
    assert tables[0] == tables[1] and pk.check_order(o.select((F.col("k") % 200).alias("i"), "v"), s.select((F.col("k") % 200).alias("i"), F.floor("v").alias("v")), "files", "files", tol=1.0) == 4
    with pytest.raises(ValueError, match="multiple"):
        pk.observed(o, "k", "v", order="files").simulated(s.filter("k < 799"), "v", order="files")
    with pytest.raises(ValueError, match="read from files"):
        align.file_index(spark.range(3))


def test_checksums_of_many_ids(spark):
    """More than 2**24 observations: the sums of hashes must not overflow."""
    n = 17_500_000
    ids = spark.range(n).withColumn("y", F.lit(1.0))
    sums = ids.agg(*[c.alias(k) for k, c in align.checksums("id").items()]).first()
    assert sums.rows == n and sums.high > 2 ** 42
    assert spark.range(3).agg(*align.checksums("id").values()).first() != spark.range(1, 4).agg(*align.checksums("id").values()).first()
