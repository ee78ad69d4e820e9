"""The stages of the pipeline on the smallest tables."""

import corpus_pipeline
from plait.llm import scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "token_ids"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == before


def test_clean_documents_stay(spark):
    rows = [(i, f"document {i} says " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 100) for i in range(30)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 30
