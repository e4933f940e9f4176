"""The stages in order, each against what its operator promises."""

import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == columns, name
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in kept.collect()]
    assert len(set(texts)) == len(texts) and 0 < len(texts) < n
    mixed = corpus_pipeline.mix(spark, kept, SF)
    assert mixed.columns == columns
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == mixed.count()


def test_odd_tables(spark):
    """Nulls in id and text, empty texts and repeated rows go through every stage; an empty table stays empty."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in given] + [tuple(r) for r in given[:5]] + [(None, given[7].text + " and more", "en", None, None), (9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "  \n ", None, "a", 4), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        none = stage(spark, docs.where("false"), SF)
        assert none.columns == after.columns and none.count() == 0, name
        if name != "byte_bpe":
            assert after.columns == docs.columns, name
            docs = spark.createDataFrame(after.collect(), schema)
    assert 0 < after.count() == docs.count()


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{k}" for k in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
