"""The pipeline's stages on a small folder of tables, each against what its operator says of the stage's own input."""

import pytest

import corpus_pipeline
from sparkweave.llm import shingle_join, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120").select(*corpus_pipeline.COLUMNS)
    odd = [(5000, None, None, None, None), (5001, "", "en", "src1", 0), (5002, "one", "en", "src1", 3), (5003, docs.where("doc_id = 7").first().text, "en", "src2", 1), (5004, "mail me.12@host.example.com now", "en", "odd", 31)]
    docs.union(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS and after.keys() <= before.keys()
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet"), use="pmod(crc32(cast(doc_id as string)), 4) != 2").where("predicted = 1").collect()}
            assert before.keys() - after.keys() == bad
        elif name == "jaccard":
            first = {r.component_id for r in shingle_join.jaccard_components(docs).collect()}
            assert after.keys() == first and not {7, 5003} <= after.keys()
        elif name == "pii":
            assert after.keys() == before.keys() and after[5004].text == "mail <EMAIL> now" and after[5004].n_chars == 16
        elif name == "mixing":
            assert len(after) > 0.5 * len(before)
        else:
            assert after.keys() == before.keys()
        docs = out


def test_run_and_empty(spark, folder, tmp_path):
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and pieces.count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
