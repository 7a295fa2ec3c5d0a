import os

import pytest

import corpus_pipeline as P
from textloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_on_edge_rows(spark, docs, empty, tmp_path):
    labels = str(tmp_path / "labels.parquet")
    spark.createDataFrame([(1, 0), (3, None)], "doc_id long, toxic int").write.parquet(labels)
    for table in (docs, empty):
        before = table.count()
        df = table
        for name, stage in P.STAGES:
            out = stage(spark, df, str(tmp_path))
            path = str(tmp_path / f"{name}-{before}")
            out.write.parquet(path)
            kept = spark.read.parquet(path)
            assert kept.count() <= df.count()
            if name != "sentencepiece":
                assert kept.columns == docs.columns[: len(kept.columns)]
            df = kept
        assert df.columns == ["doc_id", "n_tokens", "ids"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_query_runs(spark):
    for name, f in queries.QUERIES.items():
        assert f(spark, SF).count() > 0, name
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
