"""The pipeline's stages on the smallest tables, against the operators' own judgements."""

import corpus_pipeline
from pagewright.llm import neardup, quality


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.join(docs, "doc_id", "left_anti").count() == 0
    left = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert left.columns == docs.columns
    assert left.count() == neardup.components_of(kept).select("component_id").distinct().count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert list(out.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.groupby("doc_id").size().max() <= 2
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "shards"]
    assert quality.base_failed(19, 0) and quality.base_failed(100, 31) and not quality.base_failed(100, 30)
