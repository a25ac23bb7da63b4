"""Listings, point lookups and work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import MAX_TOOL_BODY, PAGE_MARK


def page(limit: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if limit is None else limit))


def list_papers(papers: DataFrame, limit: int | None = None) -> DataFrame:
    out = papers.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def get(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key) == value)


def list_topics(topics: DataFrame) -> DataFrame:
    return topics.orderBy("depth", "name", "id")


def list_gaps(gaps: DataFrame, topic: str | None = None) -> DataFrame:
    rows = gaps if topic is None else gaps.where(F.col("topic_id") == topic)
    return rows.orderBy(F.desc("priority"), "id")


def list_reports(reports: DataFrame, limit: int | None = None) -> DataFrame:
    out = reports.withColumn("sections", T.report_sections(F.col("content"))).orderBy(F.desc("generated_at"), "id")
    return out if limit is None else out.limit(limit)


def in_topic(papers: DataFrame, links: DataFrame, topic: str) -> DataFrame:
    """Papers of a topic with the link's relevance. The topic is filtered before any limit."""
    return papers.join(links.where(F.col("topic_id") == topic).select(F.col("paper_id").alias("id"), "relevance"), "id")


def papers_by_topic(papers: DataFrame, links: DataFrame, topic: str, limit: int | None = None) -> DataFrame:
    out = in_topic(papers, links, topic).orderBy(F.desc("relevance"), F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def missing_keywords(papers: DataFrame, limit: int) -> DataFrame:
    return papers.where(F.col("keywords") == "").orderBy(F.desc("created_at"), "id").limit(limit)


def missing_keywords_by_topic(papers: DataFrame, links: DataFrame, topic: str, limit: int) -> DataFrame:
    return in_topic(papers.where(F.col("keywords") == ""), links, topic).orderBy(F.desc("relevance"), F.desc("created_at"), "id").limit(limit)


def stalest(papers: DataFrame, limit: int) -> DataFrame:
    return papers.orderBy("updated_at", "id").limit(limit)


def stalest_by_topic(papers: DataFrame, links: DataFrame, topic: str, limit: int) -> DataFrame:
    return in_topic(papers, links, topic).orderBy("updated_at", "id").limit(limit)


def body_capped(bodies: DataFrame, most: int = MAX_TOOL_BODY) -> DataFrame:
    return bodies.select("paper_id", F.substring("body", 1, most).alias("body"), (F.length("body") > most).alias("truncated"))


def bodies_missing(papers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Papers with a preprint id but no body."""
    return papers.where("arxiv_id is not null").join(bodies.select(F.col("paper_id").alias("id")), "id", "left_anti")


def reingest_worklist(papers: DataFrame, bodies: DataFrame) -> DataFrame:
    """What a renewed extraction does with each paper: download, skip (marked already), extract, or nothing."""
    marks = bodies.select(F.col("paper_id").alias("id"), F.col("body").contains(PAGE_MARK).alias("marked"))
    action = F.when(F.col("pdf_path").isNull(), F.when(F.col("arxiv_id").isNotNull(), "download").otherwise("none")).when(F.coalesce("marked", F.lit(False)), "skip").otherwise("extract")
    return papers.join(marks, "id", "left").select("id", action.alias("action"))
