"""Reconciliation of tags with a remote library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OUTCOMES = ("update", "unchanged", "no_doi", "not_in_remote", "ambiguous", "conflict", "failed")


def plan(papers: DataFrame, items: DataFrame) -> DataFrame:
    """id, outcome, key, version, merged: what an export would do with each paper. Papers that share an identifier are
    one write with the union of their tags, so they are merged before they are compared with the item's tags."""
    p = papers.withColumn("k", T.normalize_doi(F.col("doi")))
    one = items.withColumn("k", T.normalize_doi(F.col("doi"))).where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("key", "version", "tags")).alias("i"))
    trimmed = F.filter(F.transform("i.tags", T.strip), lambda x: x != "")
    # of each tag of an identifier its first place among the papers, newest first: a row per tag, however many papers share it
    tags = p.where("k is not null").select("k", "created_at", "seq", F.posexplode("tags").alias("at", "tag")).withColumn("tag", T.strip(F.col("tag")))
    tags = tags.groupBy("k", "tag").agg(F.max(F.struct("created_at", "seq", (-F.col("at")).alias("at"))).alias("first"))
    siblings = tags.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("first", "tag")), asc=False).alias("s"))
    siblings = p.where("k is not null").select("k").distinct().join(siblings, "k", "left")
    own = F.coalesce(F.transform("s", lambda x: x["tag"]), F.array().cast("array<string>"))
    union = siblings.join(one, "k").select("k", F.col("i.key").alias("key"), F.col("i.version").alias("version"), "n", trimmed.alias("current"), T.merge_tags(F.col("i.tags"), own).alias("merged"))
    outcome = F.when(F.col("k").isNull(), "no_doi").when(F.col("n").isNull(), "not_in_remote").when(F.col("n") > 1, "ambiguous").when(F.col("merged") == F.col("current"), "unchanged").otherwise("update")
    out = p.join(union, "k", "left").withColumn("outcome", outcome)
    single = F.col("n") == 1
    return out.select("id", "outcome", F.when(single, F.col("key")).alias("key"), F.when(single, F.col("version")).alias("version"), F.when(F.col("outcome") == "update", F.col("merged")).alias("merged"))


def settled(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """The plan after its writes were answered (key, status): an item that changed in between, status 412, is a conflict,
    any other refusal of an update a failure."""
    said = answers.groupBy("key").agg(F.max("status").alias("__status"))
    bad = F.when(F.col("__status") == 412, "conflict").when(F.col("__status") >= 400, "failed")
    return planned.join(said, "key", "left").withColumn("outcome", F.when(F.col("outcome") == "update", F.coalesce(bad, "outcome")).otherwise(F.col("outcome"))).select(*planned.columns)


def summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("outcome").agg(F.count("*").alias("n"))
