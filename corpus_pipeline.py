"""The corpus pipeline: quality rules, quality classifier, SimHash near-duplicates, best-fit packing.

Each stage gets what its predecessor kept, written as Parquet into the shared folder and read again; all but the last return
the columns of documents.

Defined cases: a null text counts as empty, fails the rules and goes; texts of any length are read whole; rows that share a doc_id but not the text are
documents of their own, rows equal in both are one after the third stage; of near copies the least doc_id stays (null ones last); without labels of
both kinds the first two stages reject by the base rule only; columns beside doc_id and text are carried along and read by no stage; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosa.llm import packing, quality_classifier, quality_rules, simhash
from prosa.llm.common import stage, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # fitted on the whole table: the rules leave hardly any bad document to learn from
    return quality_classifier.filter_documents(docs, table(spark, sf_dir, "labels"), labelled=table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.PackingOptions(packing.public_vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: The stages hash, score and pack; SQL cannot express them. tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
