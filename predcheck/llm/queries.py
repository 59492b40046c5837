"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import token_alignment
from .chaining import substring_dedup
from .digests import SQL as EXACT_SQL, exact_dedup
from .divergence import SQL as DIVERGENCE_SQL, source_divergence
from .hamming import SQL as TOP_K_SQL, exact_top_k
from .jaccard import ngram_jaccard
from .licenses import scan
from .lm import lm_scores
from .mixing import curriculum_mixing
from .packing import best_fit_packing
from .quality import quality
from .syncmers import fingerprints
from .tables import read
from .toxicity import toxicity


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"))


def op5_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mixing(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"))


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_lm_scoring, op3_license_scan, op4_best_fit_packing, op5_curriculum_mixing, op6_substring_dedup, op7_exact_top_k, op8_syncmer_fingerprints,
                                   op9_toxicity, op10_quality, op11_token_alignment, op12_source_divergence, op13_exact_dedup)}
SQL: dict[str, str] = {"op7_exact_top_k": TOP_K_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_exact_dedup": EXACT_SQL}
