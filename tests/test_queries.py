"""Every registered query against its SQL, on the smallest tables."""

import datetime
import re

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(entry.ENTRY_DIR)


# The corpus queries without SQL are held against brute force in their own folder.
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() or not re.match(r"op\d+_|pipeline$", n)]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert compare(spark, duck, entry.ENTRY_DIR, name) is None


def test_flagship(spark):
    assert entry.entry(spark).columns == ["strat", "bin", "xbin", "qname", "y", "lo", "md", "hi"]


def test_back_transformed_with_zeros(spark, tmp_path):
    """A zero has no finite logarithm: it ranks lowest on the log scale, with its replicates, and is left in."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=3 * i), "ab"[i % 2], 0.0 if i % 80 < 2 else 1.0 + i * 7 % 90) for i in range(480)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(spark, duck, tmp_path, "back_transformed") is None
    # with the zeros left out the quantiles are others
    duck.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' WHERE value > 0")
    assert compare(spark, duck, tmp_path, "back_transformed") is not None
