"""The pipeline's stages, one by one and together."""

import json

import pytest

import brute
import corpus_pipeline as cp
from predcheck.llm import toxicity


@pytest.fixture(scope="module")
def sf(spark, docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


STAGES = dict(cp.STAGES)


def test_order():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_copies", "passages", "mixing", "packing"] and cp.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns(spark, sf, odd, empty, name):
    assert STAGES[name](spark, odd, sf).columns == odd.columns
    assert STAGES[name](spark, odd, sf).dtypes == odd.dtypes
    none = STAGES[name](spark, empty, sf)
    assert none.columns == empty.columns and none.count() == 0


def test_toxicity_stage_keeps_what_it_does_not_reject(spark, sf, odd):
    scored = toxicity.score(odd, toxicity.learn(odd, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert STAGES["toxicity"](spark, odd, sf).count() == sum(r.score < toxicity.CUT for r in scored)


def test_near_copies_stage(spark, sf, docs, rows):
    kept = {r.doc_id for r in STAGES["near_copies"](spark, docs, sf).select("doc_id").collect()}
    assert kept == set(brute.components([(r[0], r[1]) for r in rows]).values())


def test_whole(spark, sf):
    got = cp.run(spark, sf).toPandas()
    filled = got.groupby("sequence_id")["length"].sum()
    assert len(got) and filled.max() <= 2048
    assert json.dumps(list(got.columns)) == json.dumps(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
