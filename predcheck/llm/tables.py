"""Tables of the session: reading, intermediate storage, and small Arrow helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.storage import materialize as store, shared_dir

__all__ = ["batch", "broadcast_if", "held_out", "read", "sized", "store", "shared_dir", "text_of"]

#: Rows of a two- or three-number table that may be sent to every executor.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, *others: str) -> DataFrame:
    """Only the named columns and the text, so that clashing or extra columns never matter."""
    return docs.select(*others, F.col("text").cast("string").alias("text"))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """Store a table once and count it from the files."""
    kept = store(df)
    return kept, kept.count()


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for at most BROADCAST_ROWS counted rows of a few numbers; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def batch(names, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=list(names))
