"""Observed and simulated tables derived from the driver's ``events`` and ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from predcheck.functions.values import as_column


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event: obs_id, strat, x (hour of day), y, pred, lloq, blq."""
    e = load(spark, sf_dir, "events")
    hour = F.hour("ts").cast("double")
    return e.select(F.col("event_id").alias("obs_id"), F.col("event_type").alias("strat"),
                    (hour + F.minute("ts") / F.lit(60.0)).alias("x"), F.col("value").alias("y"), (hour + 30.0).alias("pred"),
                    F.when(F.col("event_type").isin("click", "view"), 5.0).otherwise(2.0).alias("lloq")) \
        .withColumn("blq", F.col("y") < F.col("lloq"))


def sim_events(spark: SparkSession, sf_dir: str, replicates: int = 20, value="value") -> DataFrame:
    """Every event once per replicate, its value (or another column) scaled by a factor that depends on the event and the replicate."""
    # One small file is one task: spread the events before they are multiplied.
    events = load(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism, "event_id")
    rows = events.select(
        F.col("event_id").alias("obs_id"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("repl"), as_column(value).alias("value"))
    mix = (F.col("obs_id") * 31 + F.col("repl") * 17 + F.col("obs_id") * F.col("repl")) % 101
    return rows.select("obs_id", "repl", (F.col("value") * (mix.cast("double") / 100.0 + 0.5)).alias("y_sim"))


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order: obs_id, x (days since 1990), y, status, priority, pred."""
    o = load(spark, sf_dir, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderkey").alias("obs_id"), days.alias("x"), F.col("o_totalprice").alias("y"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                    (days + 1000.0).alias("pred"))
