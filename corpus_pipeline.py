"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return
the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from predcheck.llm import chaining, jaccard, mixing, packing, toxicity as tox
from predcheck.llm.tables import read, store


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date after texts were cut."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier rejects go."""
    model = tox.learn(docs, read(spark, sf_dir, "labels"))
    return docs.filter(tox.scorer(model)(F.col("text").cast("string")) < tox.CUT)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join stays."""
    return jaccard.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds too are cut out; all documents stay."""
    return _counted(chaining.drop_passages(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights, in curriculum order; a document may be there up to three times."""
    return _counted(mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 2048 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("passages", passages), ("mixing", mix), ("packing", pack)]

#: No stage but the mixing targets has a form in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
