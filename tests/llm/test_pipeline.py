"""The pipeline's stages, one after another, on the smallest tables."""

import corpus_pipeline
from lattica.llm.shared import Table

from ..compare import connect, same

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Table(stage(spark, docs, SF), name).read()
        if n < 4:
            assert docs.columns == columns and before * 0.7 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_exact_dedup_matches_sql(spark):
    from lattica.llm import registry

    same(spark, connect(SF), registry.queries()["op1_exact_dedup"], registry.oracle_sql()["op1_exact_dedup"], SF)
