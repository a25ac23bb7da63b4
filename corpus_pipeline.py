"""The corpus pipeline: quality, near duplicates, benchmark copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklore.llm.common import Scratch, cleared, read_table
from stacklore.llm.decontamination import contaminated
from stacklore.llm.jaccard_join import jaccard_join
from stacklore.llm.line_crf import fit_quality, with_quality
from stacklore.llm.packing import best_fit_packing
from stacklore.llm.secrets import redact_secrets
from stacklore.llm.stages import one_of_each, row_key, with_ids, without


#: Rows that pass between Spark and Python at a time in this application's session; whole texts make wide rows.
ARROW_ROWS = "1000"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; its model is fitted on the labels of the documents at hand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return with_quality(docs, model, "__score").where(F.col("__score") >= 0.5).drop("__score")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, the one of the least doc_id."""
    return one_of_each(docs, jaccard_join(with_ids(docs), keys=True))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    found = contaminated(docs.select(row_key().alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("key")))


def secretless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", clean_documents),
    ("secret_scan", secretless_documents),
    ("best_fit_packing", packed_sequences),
]

#: Learned and approximate stages have no SQL; tests/llm holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written and read again, and what the stage and the one before it left is deleted."""
    docs, scratch, before = read_table(spark, sf_dir, "documents"), Scratch(spark), ()
    for name, stage in STAGES[:-1]:
        with cleared():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = (name,)
    return STAGES[-1][1](spark, docs, sf_dir)
