import os
import random
import sys

import pytest
from pyspark.sql import Row, types as T

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def table():
    """Plain texts, copies, near copies, shared passages, very short and very long texts, nulls, junk and repeated rows."""
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 2, 4, 5, 6, 20, 60, 150, 400])) for _ in range(60)]
    long = prose(rng, 20_000, 5000)
    base, passage = prose(rng, 120, 3000), prose(rng, 70, 9000)
    near = []
    for i in range(12):
        w = base.split()
        for j in rng.sample(range(len(w)), 2):
            w[j] = f"x{i}y{j}"
        near.append(" ".join(w))
    texts += [long, long, base, base, *near, *(f"{prose(rng, 80)} {passage} {prose(rng, 40)}" for _ in range(6))]
    texts += ["", " \n\t ", None, "one", "one", "ÄÖ été ñandú", "the " * 300, "the " * 200, "A B c\x85d", "<|endoftext|> x",
              "Licensed under the Apache License, Version 2.0.", "Released Under the MIT License", "photo (CC BY-NC 4.0)", "x" * 5000]
    return [(i, t, "en", ("s0", "s1", "s2", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return table()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Nulls in every column, repeated rows, one id with two texts, and further columns with clashing names."""
    extra = [(None, None, None, None, None), (None, "no id at all", None, None, None), (7, rows[7][1], "en", "s3", None),
             (7, rows[7][1], "en", "s3", None), (8, "another text for one id " * 20, None, None, 1), (-5, rows[20][1], "en", "s0", 3)]
    names = ["gram", "node", "label", "size", "part", "group", "words", "score", "__id", "n", "position"]
    frame = spark.createDataFrame([*rows, *extra], SCHEMA)
    for i, c in enumerate(names):
        frame = frame.selectExpr("*", f"cast(doc_id + {i} as string) as `{c}`")
    return frame.repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    data = [Row(doc_id=r[0], quality=int(r[0] % 5 != 0), toxic=int(r[0] % 7 == 0)) for r in rows]
    frame = spark.createDataFrame(data)
    odd = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0), (10**9, 1, 0)], "doc_id long, quality long, toxic long")
    return frame.unionByName(odd)
