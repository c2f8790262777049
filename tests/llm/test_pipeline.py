"""The pipeline over a whole small table, stage by stage against what each stage promises."""

import corpus_pipeline
from idsets.llm import decontaminate, quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            good = {r.doc_id for r in quality_classifier.predictions(before, labels).filter("predicted = 1").collect()}
            assert kept[-1] == good
        if k == 2:
            assert kept[-1] == kept[-2]
        if k == 3:
            benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert kept[-1] == {r.doc_id for r in decontaminate.digests(before, benchmark).filter("NOT contaminated").collect()}
    assert kept[-1] == kept[-2]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert 0 < got.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
