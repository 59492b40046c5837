"""Preparation of input tables: record filters, covariate joins, derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.values import as_column


def keep_records(df: DataFrame, condition=None, present: Sequence[str] = ()) -> DataFrame:
    """Keep rows that meet ``condition`` and have a value in every ``present`` column."""
    for name in present:
        df = df.filter(F.col(name).isNotNull())
    return df if condition is None else df.filter(as_column(condition))


def natural_left_join(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Left join on all column names the tables share; several matches give several rows."""
    right = right.select(*columns) if columns is not None else right
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables share no column name")
    return left.join(right, common, "left")


def derive(df: DataFrame, **columns) -> DataFrame:
    """Add or replace columns by expressions, Columns or constants."""
    return df.withColumns({name: as_column(value) for name, value in columns.items()})
