"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (embed_dedup, html_extract, lexical_search, license_scan, lm_score, mixing, ngram_join, packing, periodic_runs,
               quality_rules, sharding, token_records, toxicity)
from .common import documents
from .oracles import ORACLES


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir).select("doc_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html_extract.extract(documents(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", "n_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold_of(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(False))
    return (toxicity.score(docs, index, evidence=False)
            .select("doc_id", held_out.alias("held_out"), "score", "predicted"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write(documents(spark, sf_dir), token_records.output_folder(spark))
    return token_records.read(manifest)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.planted(documents(spark, sf_dir).select("doc_id", "text"))))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_embedding_dedup, op3_lm_scoring, op4_html_extraction, op5_mixing, op6_packing, op7_license_scan,
    op8_quality_rules, op9_sharding, op10_toxicity, op11_token_records, op12_lexical_search, op13_periodic_runs)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
