"""Prediction correction: move every value to the typical prediction of its bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.values import no_nan, ratio


def median_prediction(obs: DataFrame, keys: Sequence[str], largest: int) -> DataFrame:
    """(keys, ``mpred``); a bin with any missing prediction has none."""
    got = grouped_quantiles(obs.select(*keys, "pred"), list(keys), "pred", [0.5], largest=largest,
                            extra=[F.count(F.lit(1)).alias("rows")])
    return got.select(*keys, F.when(F.col("n") == F.col("rows"), F.col("q")[0]).alias("mpred"))


def correction(log: bool, lower_bound: float = 0.0) -> Column:
    """Per observation: the shift on the log scale, else the factor on the distance to the lower bound."""
    pred, mpred = F.col("pred"), F.col("mpred")
    if log:
        return no_nan(mpred - pred)
    return ratio(mpred - lower_bound, pred - lower_bound) if lower_bound else ratio(mpred, pred)


def corrected(y: Column, pc: Column, log: bool, lower_bound: float = 0.0) -> Column:
    if log:
        return no_nan(pc + y)
    if lower_bound:
        return no_nan((y - lower_bound) * pc + lower_bound)
    return no_nan(pc * y)


def with_correction(obs: DataFrame, log: bool, lower_bound: float) -> DataFrame:
    """Add ``pc`` and ``ypc`` to observations that know the ``mpred`` of their bin."""
    return obs.withColumn("pc", correction(log, lower_bound)).withColumn("ypc", corrected(F.col("y"), F.col("pc"), log, lower_bound))
