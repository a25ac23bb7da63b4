"""Token counts by a tokenizer compiled to finite-state form (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import count_tokens
from .common import read_table, slices, text_or_empty, texts_of

LIMIT = 1024


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. Null text counts as empty; repeated rows and null ids stay
    as they are; an empty table gives no rows; other columns are not read. Narrow: one map over the scan, whatever
    the keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = texts_of(batch.column(1))
            n = count_tokens(texts, vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
