"""Shared storage for intermediate tables, and the sizes that decide between plans.

Nothing here keeps data on one machine of a cluster: an intermediate table goes to the folder the
cluster names in ``spark.checkpoint.dir``, so it outlives any executor and cuts the lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one group that a single task may sort. Larger groups are split by value.
SPLIT_ROWS_CONF = "predcheck.splitRows"
SPLIT_ROWS_DEFAULT = 4_000_000

#: Largest estimated size, in bytes, of a table sent to every executor.
BROADCAST_CONF = "predcheck.broadcastBytes"
BROADCAST_BYTES = 64 * 1024 * 1024

_local_dirs: dict[str, str] = {}


def split_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SPLIT_ROWS_CONF, str(SPLIT_ROWS_DEFAULT)))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only when Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="predcheck-")
    return _local_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later uses scan the files instead of recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/predcheck-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int = 256) -> DataFrame:
    """Hint a broadcast when the counted rows fit; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= broadcast_bytes(df.sparkSession) else df


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest group); counted with map-side aggregation."""
    if not keys:
        return 1, df.count()
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("groups"), F.max("n").alias("rows")).first()
    return row["groups"], row["rows"] or 0


#: Tables of at most this many rows are kept as literal rows of the plan instead of files.
COMPACT_ROWS = 10_000


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """Evaluate a small table once: (stored table, row count). Larger ones go to the shared folder."""
    rows = df.limit(COMPACT_ROWS + 1).toArrow()
    if rows.num_rows <= COMPACT_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows
    stored = materialize(df)
    return stored, stored.count()
