"""The corpus pipeline: quality rules, quality classifier, near-duplicate groups, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. A row with a null doc_id passes the filters
like any other, is a group of its own, and loses no passage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.additive_model import quality_classifier
from cellwise.llm.ngram_join import ngram_jaccard_join
from cellwise.llm.packing import pack_documents
from cellwise.llm.quality_rules import quality_rules
from cellwise.llm.substring import substring_dedup
from cellwise.session import read_table, stored

#: No stage that trains or tokenizes has a form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, read_table(spark, sf_dir, "labels"), prefix="_").where("_kept").select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality_classifier(docs, read_table(spark, sf_dir, "labels"), prefix="_").where("_predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group.

    Of its rows that are equal in text one stays, the smallest in the other columns; rows of one id with different texts all stay.
    """
    joined = ngram_jaccard_join(docs.select("doc_id", "text"))
    first = joined.where("component_id = doc_id").select(F.col("doc_id").alias("_id")).distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.join(first, docs.doc_id == F.col("_id"), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    return kept.select("doc_id", "text", "_rest.*").select(*docs.columns).union(docs.where("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that one with a smaller id has; texts that lose nothing stay as they are."""
    cut = substring_dedup(docs, prefix="_")
    changed = F.col("_n_removed") > 0
    return cut.withColumns({"text": F.when(changed, F.col("_kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length("_kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, none across documents."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
