"""Observed quantiles, simulated quantiles per replicate, and their intervals over the replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.values import NEG_INF, no_nan


def censored(value: Column, blq: Column) -> Column:
    """Values below the limit rank lowest; without a flag or a value there is nothing to rank."""
    return no_nan(F.when(blq, value + F.lit(NEG_INF)).when(~blq, value))


def long_quantiles(df: DataFrame, keys: Sequence[str], value: str, qpred: Sequence[float], qtype: int, largest: int,
                   split_keys: Sequence[str] | None = None) -> DataFrame:
    """(keys, ``q_index``, ``y``): one row per group and probability. A quantile among censored values is missing."""
    return to_long(grouped_quantiles(df, list(keys), value, qpred, qtype, largest=largest, split_keys=split_keys), keys)


def to_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wide.select(*keys, F.posexplode("q").alias("q_index", "__q")) \
        .select(*keys, "q_index", F.expr("if(__q != double('-infinity'), __q, null) as y"))


def interval_probs(conf_level: float) -> list[float]:
    tail = (1 - conf_level) / 2
    return [tail, 0.5, 1 - tail]


def over_replicates(per_replicate: DataFrame, keys: Sequence[str], conf_level: float, qtype: int, replicates: int) -> DataFrame:
    """(keys, lo, md, hi): quantiles of the column ``y`` over the replicates, missing values left out."""
    got = grouped_quantiles(per_replicate.select(*keys, "y"), list(keys), "y", interval_probs(conf_level), qtype, largest=replicates)
    return got.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("lo", "md", "hi"))])


def share_below() -> Column:
    """Percent of true ``blq`` flags of a group; missing when any flag is missing."""
    return F.when(F.count(F.lit(1)) == F.count("blq"), F.avg(F.col("blq").cast("double")) * 100)


def share_of(flagged: str, flags: str, rows: str) -> Column:
    """The same percentage from the numbers of true flags, of flags and of rows."""
    return F.when(F.col(rows) == F.col(flags), F.col(flagged) / F.col(rows) * 100)


def percent_below(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``y``): percent of true ``blq`` flags; missing when any flag of the group is missing."""
    return df.groupBy(*keys).agg(share_below().alias("y"))
