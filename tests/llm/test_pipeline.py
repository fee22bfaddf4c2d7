import corpus_pipeline
from lucerna.llm import minhash_dedup, mixing, quality_rules
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).toPandas()) if name != "tokens" else stage(spark, now, SF)
        kept.append(now)
        if name != "tokens":
            assert now.columns == columns
    language, quality, dedup, mixed, tokens = kept
    good = {r.doc_id for r in quality_rules.quality_signals(language).where("kept").collect()}
    assert {r.doc_id for r in quality.collect()} == good
    one = {r.doc_id for r in minhash_dedup.groups(quality).where("kept").collect()}
    assert {r.doc_id for r in dedup.collect()} == one
    times = {r.doc_id: r.times for r in mixing.mix(dedup).collect() if r.times}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times
    assert tokens.where("not decoded_ok").count() == 0 and tokens.count() == mixed.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
