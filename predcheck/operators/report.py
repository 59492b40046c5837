"""The tables behind a plot of a predictive check, and the four-table report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.values import null_safe_join
from ..plans.storage import compact, small, split_rows
from .align import dense_index
from .statistics import interval_probs


def ribbon(vpc) -> DataFrame:
    """The statistics by x with a percent label per quantile."""
    labels = F.array(*[F.lit(f"{100 * p:.15g}%") for p in vpc.qpred])
    return vpc.interval_table().select(*vpc.strata, "xbin", "qname", F.element_at(labels, F.col("q_index") + 1).alias("label"),
                                       "y", "lo", "md", "hi")


def points(vpc) -> DataFrame:
    """Observed points, prediction corrected if the check is."""
    return vpc.corrected_obs().select("obs_id", *vpc.strata, "x", F.col("ypc" if vpc.predcor else "y").alias("y"))


def bin_colors(vpc) -> DataFrame:
    """Bins of every stratum numbered by their mean x."""
    means = vpc.obs().groupBy(*vpc.strata, "bin").agg(F.avg("x").alias("xmean"), F.min("bin_num").alias("bin_num")).filter("bin is not null")
    # bins are numbered by a range sort over all strata: no stratum's bins have to meet in one task
    placed = dense_index(means, [*vpc.strata, "xmean", "bin_num", "bin"], "__at")
    firsts = placed.groupBy(*vpc.strata).agg(F.min("__at").alias("__first"))
    numbered = null_safe_join(placed, firsts, vpc.strata) if vpc.strata else placed.crossJoin(F.broadcast(firsts))
    return numbered.withColumn("color", (F.col("__at") - F.col("__first") + 1).cast("int")).drop("__at", "__first", "bin_num")


def colored_points(vpc) -> DataFrame:
    colors = bin_colors(vpc).drop("xmean")
    keys = [*vpc.strata, "bin"]
    value = F.col("ypc" if vpc.predcor else "y").alias("y")
    return null_safe_join(vpc.corrected_obs(), colors, keys).select("obs_id", *keys, "x", value, "color")


def boundaries(vpc) -> DataFrame:
    """Distinct bin edges of every stratum."""
    return vpc.bininfo().select(*vpc.strata, F.explode(F.array("xleft", "xright")).alias("x")).distinct()


def _numbered(table: DataFrame, terms: list[str], name: str) -> DataFrame:
    """Add the number, from 1, of the combination of ``terms`` in sorted order.

    One task orders the combinations only up to a counted number; more are numbered by a range sort."""
    combinations, n = compact(table.select(*terms).distinct())
    if n <= split_rows(table.sparkSession):
        places = combinations.withColumn(name, F.row_number().over(Window.orderBy(*terms)))
    else:
        places = dense_index(combinations, terms, name).withColumn(name, (F.col(name) + 1).cast("int"))
    return null_safe_join(table, small(places, n), terms)


def facets(vpc) -> DataFrame:
    """One row per combination of strata: place in a grid (two-sided) or in a sequence (one-sided)."""
    levels = vpc.obs().groupBy(*vpc.strata).agg(F.count(F.lit(1)).alias("nobs"))
    sides = {"facet_row": vpc.strat_rows, "facet_col": vpc.strat_cols} if vpc.two_sided else {"facet": vpc._strata()}
    for name, terms in sides.items():
        levels = _numbered(levels, [n for n, _ in terms], name) if terms else levels.withColumn(name, F.lit(1))
    return levels


def observation_labels(vpc) -> DataFrame:
    """Number of observations of every bin, to be written at its middle."""
    return vpc.bininfo().select(*vpc.strata, F.col("xmid").alias("x"), F.col("nobs").alias("label"))


def rug(vpc) -> DataFrame:
    """Left and right edge of every bin."""
    return vpc.bininfo().select(*vpc.strata, "xleft", "xright")


def filter_levels(df: DataFrame, levels: dict[str, Sequence]) -> DataFrame:
    """Keep the chosen levels of every named stratum."""
    for name, chosen in levels.items():
        df = df.filter(F.col(name).isin(list(chosen)))
    return df


def back_transform(df: DataFrame, columns: Sequence[str] = ("y", "lo", "md", "hi")) -> DataFrame:
    return df.withColumns({c: F.exp(c) for c in columns})


def floor_values(df: DataFrame, least: float, columns: Sequence[str] = ("y", "lo", "md", "hi")) -> DataFrame:
    """Values below ``least`` become ``least``; missing values stay missing."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(float(least)))) for c in columns})


def quantile_order(stats: DataFrame) -> DataFrame:
    """Quantile names ranked by their mean observed value."""
    means = stats.groupBy("qname").agg(F.avg("y").alias("mean_y"))
    return means.withColumn("place", F.dense_rank().over(Window.orderBy(F.col("mean_y").asc_nulls_last())))


def interval_width(vpc) -> float:
    """Width of the interval in percent, for legends."""
    low, _, high = interval_probs(vpc.conf_level)
    return round(100 * (high - low), 10)


def report(vpc) -> dict[str, DataFrame]:
    """PI, BINS, DVC and PCTBLQ (absent without values below the limit)."""
    keys = [*vpc.strata, "bin"]
    info = vpc.bininfo()
    names = {"xmin": "XMIN", "xmax": "XMAX", "xmid": "XMID", "xmedian": "XMED", "xmean": "XMEAN", "xleft": "XLEFT",
             "xright": "XRIGHT", "xcenter": "XCENTER"}
    coords = info.select(*keys, *[F.col(a).alias(b) for a, b in names.items()], F.col("nobs").alias("NOBS"))
    levels = [f"SIM{100 * p:.12g}%CI" for p in interval_probs(vpc.conf_level)]

    def renamed(table, qname):
        sims = [F.col(c).alias(n) for c, n in zip(("lo", "md", "hi"), levels)]
        table = table.select(*keys, qname.alias("QNAME"), F.col("y").alias("RAWOBS"), *sims)
        return null_safe_join(table, coords.drop("NOBS"), keys).drop("bin")

    labels = F.array(*[F.lit(f"{100 * p:.15g}%PI") for p in vpc.qpred])
    limits = vpc.obs().groupBy(*keys).agg(F.min("lloq").alias("LLOQ"))
    out = {"PI": renamed(vpc.interval_table(), F.element_at(labels, F.col("q_index") + 1)),
           "BINS": null_safe_join(coords, limits, keys).drop("bin"),
           "DVC": points(vpc).select(*vpc.strata, F.col("x").alias("TIME"), F.col("y").alias("DVC"))}
    below = vpc.pctblq
    if below is not None:
        out["PCTBLQ"] = renamed(below, F.lit("PCTBLQ"))
    return out
