"""The queries op1_ to op13_ and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import centroids, embedding_dedup, html_text, language_id, lexical_search, minhash_dedup, mixing, ngram_lm, pieces, pii, quality_rules, toxicity, warc
from lucerna.llm.common import fold, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", *toxicity.FEATURES)


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    limits = quality_rules.fit(quality_rules.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality_rules.quality_signals(docs, limits=limits)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.crawl_of(table(spark, sf_dir, "pages")))
    named = {"etag": "etag", "cache_control": "cache-control", "content_type": "content-type"}
    return found.select("record_id", "canonical_url", "response_id", "outcome", *[F.element_at("headers", h).alias(c) for c, h in named.items()])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.label(docs, language_id.train(language_id.training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans", "spans")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.groups(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_ngram_lm, op4_mixing, op5_quality_rules, op6_warc, op7_language_id, op8_minhash_dedup, op9_pieces, op10_embedding_dedup, op11_centroids, op12_lexical_search, op13_pii)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.MIX_SQL, "op6_warc": warc.WARC_SQL, "op11_centroids": centroids.CENTROIDS_SQL, "op12_lexical_search": lexical_search.SEARCH_SQL}
