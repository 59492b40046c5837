"""One row per bin: counts, centre statistics and the edges halfway to the neighbouring bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.values import null_safe_join
from ..plans.storage import small, split_rows
from .align import dense_index

# The names of the columns of bin information.
INFO_COLUMNS = ("nobs", "xmedian", "xmean", "xmin", "xmax", "xmid", "xleft", "xright", "xcenter")


def _basic(obs: DataFrame, keys: list[str], largest: int, extra: Sequence[Column]) -> DataFrame:
    own = {*keys, "q", "n"}
    got = grouped_quantiles(obs, keys, "x", [0.5], largest=largest, extra=[
        F.min("bin_num").alias("bin_num"), F.avg("x").alias("xmean"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), *extra])
    return got.select(*keys, F.col("n").alias("nobs"), F.col("q")[0].alias("xmedian"), *[c for c in got.columns if c not in own],
                      F.expr("(xmin + xmax) * 0.5D as xmid"))


def _neighbours(info: DataFrame, within: list[str], most_bins: int) -> DataFrame:
    """Add ``__prev`` (xmax of the bin to the left) and ``__next`` (xmin of the bin to the right)."""
    if most_bins <= split_rows(info.sparkSession):
        w = Window.partitionBy(*within).orderBy("xmin", "bin")
        return info.withColumns({"__prev": F.lag("xmax").over(w), "__next": F.lead("xmin").over(w)})
    # So many bins that one task should not order them: number them and look one place up and down.
    placed = dense_index(info, [*within, "xmin", "bin"], "__at")
    sides = placed.select(*within, "__at", "xmin", "xmax")
    left = sides.select(*within, (F.col("__at") + 1).alias("__at"), F.col("xmax").alias("__prev"))
    right = sides.select(*within, (F.col("__at") - 1).alias("__at"), F.col("xmin").alias("__next"))
    placed = null_safe_join(placed, left, [*within, "__at"])
    return null_safe_join(placed, right, [*within, "__at"]).drop("__at")


def bin_information(obs: DataFrame, strata: Sequence[str], by_strata: bool, largest: int, bins: int,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """``obs`` holds strata, bin, bin_num, x and what ``extra``, more aggregates per (strata, bin), needs.

    Pooled statistics are repeated for every stratum of a bin.
    """
    more = [c.alias(n) for n, c in (extra or {}).items()]
    strata = list(strata)
    within = strata if by_strata else []
    keys = [*within, "bin"]
    pooled = bool(strata) and not by_strata
    info = _neighbours(_basic(obs, keys, largest, () if pooled else more), within, bins)
    info = info.selectExpr("*", "coalesce((xmin + __prev) * 0.5D, xmin) as xleft", "coalesce((xmax + __next) * 0.5D, xmax) as xright") \
        .selectExpr("*", "(xleft + xright) * 0.5D as xcenter")
    if pooled:
        pairs = obs.groupBy(*strata, "bin").agg(F.count(F.lit(1)).alias("__c"), *more).drop("__c")
        info = null_safe_join(pairs, small(info, bins), ["bin"])
    return info.select(*strata, "bin", "bin_num", *INFO_COLUMNS, *(extra or {}))
