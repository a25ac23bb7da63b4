"""Citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAIR = ["citing", "cited"]


def new_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """The first of each new pair that the graph doesn't have; its count is the number inserted."""
    rest = [c for c in incoming.columns if c not in PAIR]
    first = incoming.groupBy(*PAIR).agg(F.min_by(F.struct(*rest), F.struct("seq", *[c for c in rest if c != "seq"])).alias("r")).select(*PAIR, "r.*")
    return first.join(edges.select(*PAIR), PAIR, "left_anti")


def insert_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    return edges.unionByName(new_edges(edges, incoming).select(*edges.columns))


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels' context where there is one; no edge is made. Adds changed."""
    new = labels.groupBy(*PAIR).agg(F.max("context").alias("__new"))
    out = edges.join(new, PAIR, "left")
    return out.select(*PAIR, F.coalesce("__new", "context").alias("context"), *[c for c in edges.columns if c not in (*PAIR, "context")], F.col("__new").isNotNull().alias("changed"))


def label_intents(edges: DataFrame, intents: DataFrame, papers: DataFrame, cited_by: bool = False) -> DataFrame:
    """Labels (paper_id, doi, label) of a paper's references, or of the papers that cite it, applied to stored edges whose
    other paper has that doi. Blank labels say nothing and change nothing."""
    own, other = ("cited", "citing") if cited_by else ("citing", "cited")
    known = papers.select(T.normalize_doi(F.col("doi")).alias("k"), F.col("id"), "seq").where("k is not null").groupBy("k").agg(F.min_by("id", "seq").alias(other))
    said = intents.where(T.strip(F.coalesce("label", F.lit(""))) != "")
    named = said.withColumn("k", T.normalize_doi(F.col("doi"))).join(known, "k").select(F.col("paper_id").alias(own), other, F.col("label").alias("context"))
    return label_edges(edges, named)


def edges_of(linked: DataFrame, cited_by: bool = False) -> DataFrame:
    """Edges of papers with related ones (source_id, paper_id) that the library has: to its references, or from the papers
    that cite it. Contexts are blank, positions in order of id."""
    own, other = ("cited", "citing") if cited_by else ("citing", "cited")
    pairs = linked.select(F.col("source_id").alias(own), F.col("paper_id").alias(other)).where(F.col(own) != F.col(other)).distinct()
    return pairs.select(*PAIR, F.lit("").alias("context"), F.row_number().over(Window.partitionBy(own).orderBy(other)).cast("long").alias("seq"))


def listing(edges: DataFrame, papers: DataFrame, paper_ids: DataFrame, cited_by: bool = False) -> DataFrame:
    """For each of the papers its edges in order, with the title at the other end."""
    own, other = ("cited", "citing") if cited_by else ("citing", "cited")
    mine = edges.join(paper_ids.select(F.col("id").alias(own)), own, "left_semi")
    titles = papers.select(F.col("id").alias(other), "title")
    return mine.join(titles, other, "left").select(F.col(own).alias("paper_id"), F.col(other).alias("other_id"), F.coalesce("title", F.lit("(paper not in library)")).alias("title"), "context", "seq")


def label_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("context") != "").alias("labelled"), F.count_if(F.col("context") == "").alias("unlabelled"))
