"""Training-corpus pipeline: stages over ``documents``, each written and reread.

Every stage works on all rows its predecessor kept and returns the columns of
``documents``, but for the last, which returns packed pieces.  Defined results
for nulls, empty texts, ties, repeated rows and empty tables are those of the
operators; a document counts as rejected by toxicity when its predicted label
is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlens.llm import mixing, ngram_join, packing, quality_rules, toxicity
from twinlens.llm.common import documents, saved


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the nearest labelled examples call toxic."""
    index = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, index)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a quality rule rejects."""
    return quality_rules.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come near their target weights."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into windows."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("quality rules", quality), ("n-gram Jaccard join", near_copies),
          ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None       # the first stage learns a classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
