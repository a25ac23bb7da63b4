"""Row filters that the pipeline makes of the operators' results.

A row is known by its doc_id and its text together, as one id may stand at several texts and some rows have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Keys which may be broadcast; above that many the join is shuffled.
MAX_IDS = 500_000
#: Stand-in ids begin here.
STAND_IN = 1 << 62


def text_key() -> Column:
    """Digest of the text, null for a null text."""
    return F.unhex(F.md5(F.encode(F.col("text").cast("string"), "UTF-8")))


def row_key() -> Column:
    """Digest of doc_id and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.encode(F.concat(part("doc_id"), F.lit(":"), part("text")), "UTF-8")))


def row_id() -> Column:
    """The doc_id; for rows without one an id made of their text, above all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(STAND_IN) + F.pmod(F.xxhash64("text"), F.lit(STAND_IN - 1)))


def with_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", row_id())


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``row_key`` isn't among ``keys`` (key)."""
    keys = Scratch(docs.sparkSession).save(keys.select("key").distinct(), "keys")
    keyed = docs.withColumn("__key", row_key())
    return keyed.join(F.broadcast(keys) if keys.count() <= MAX_IDS else keys, F.col("__key") == F.col("key"), "left_anti").select(*docs.columns)


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class of ``jaccard_join(with_ids(docs), keys=True)``: the one of the least doc_id, of rows without
    one if the class has no others. Rows of null text are classes of their own and stay."""
    scratch = Scratch(docs.sparkSession)
    stays = (F.col("key") == F.col("class_key")) & (F.col("doc_id") == F.col("first_id"))
    rows = classes.where("key is not null").groupBy("doc_id", "key").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("rows"))
    rows = scratch.save(rows.where("not stays or rows > 1"), "classes")
    gone, twice = (rows.where(x).select(F.col("doc_id").alias("__id"), F.col("key").alias("__text")) for x in ("not stays", "stays"))
    keyed = docs.withColumns({"__id": row_id(), "__text": text_key()})
    few = lambda x: F.broadcast(x) if x.count() <= MAX_IDS else x
    kept = keyed.join(few(gone), ["__id", "__text"], "left_anti")
    if not twice.isEmpty():
        again = keyed.join(few(twice), ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"])
        kept = kept.join(few(twice), ["__id", "__text"], "left_anti").unionByName(again)
    return kept.select(*docs.columns)
