"""Input tables: CSV with a header, Parquet, catalog tables, and replicates stored by observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """Read a data set. CSV types are inferred when no schema is given (one extra pass over the text)."""
    kind = format or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    if kind == "table":
        return spark.table(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Store a result table."""
    writer = df.write.format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def store_replicates(sim: DataFrame, table: str, y: str, id: str | list[str], repl: str = "repl", buckets: int = 200, path: str | None = None) -> DataFrame:
    """Replicates as a catalog table in ``buckets`` buckets by observation, narrow and ready for ``simulated``.

    A check that reads them joins each bucket with its observations where it lies: only the observations are shuffled, however many replicates there are. One bucket
    should fit a task: about the rows of all replicates / 10 million. ``path`` makes the table external. Rows with a missing id are kept."""
    ids = [id] if isinstance(id, str) else list(id)
    narrow = sim.select(*ids, repl, y).repartition(buckets, *ids)
    writer = narrow.write.format("parquet").bucketBy(buckets, ids[0], *ids[1:]).mode("errorifexists")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return sim.sparkSession.table(table)
