"""Counts over a library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import HISTORY, PAPER_STATUS, READING_STATUS


def overview(topics: DataFrame, papers: DataFrame, gaps: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of counts: one pass over each table, joined as single rows."""
    done = papers.agg(F.count("*").alias("papers"), F.count_if(F.col("reading_status") == "completed").alias("papers_read"), F.count_if(F.col("reading_status") == "queued").alias("queued"), F.count("rating").alias("rated"))
    rest = [x.agg(F.count("*").alias(n)) for n, x in (("topics", topics), ("gaps", gaps), ("reports", reports))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rest, done)


def funnel(papers: DataFrame, column: str) -> DataFrame:
    """Count for each stage in order, zero where no paper is at it."""
    stages = PAPER_STATUS if column == "status" else READING_STATUS
    dim = papers.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "position int, stage string")
    counts = papers.groupBy(T.one_of(F.col(column), stages).alias("stage")).agg(F.count("*").alias("n"))
    return dim.join(counts, "stage", "left").select("position", "stage", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def history(papers: DataFrame, gaps: DataFrame, reports: DataFrame, most: int = HISTORY) -> DataFrame:
    """The latest events of each kind. Each stream is cut by its own top-k before the union."""
    streams = (
        papers.select(F.lit("paper").alias("kind"), F.col("created_at").alias("date"), "id", F.col("title").alias("label"), T.provenance(F.col("arxiv_id"), F.col("s2_id"), F.col("pdf_path")).alias("detail")),
        gaps.select(F.lit("gap").alias("kind"), F.col("discovered_at").alias("date"), "id", F.col("description").alias("label"), F.col("topic_id").alias("detail")),
        reports.select(F.lit("report").alias("kind"), F.col("generated_at").alias("date"), "id", F.col("title").alias("label"), F.lit("").alias("detail")),
    )
    return reduce(DataFrame.unionByName, [s.orderBy(F.desc("date"), "id").limit(most) for s in streams])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ingest_summary(resolved: DataFrame, source: str) -> DataFrame:
    return resolved.groupBy(F.col(source).alias("source")).agg(F.count_if(F.col("matched_id").isNull()).alias("added"), F.count_if(F.col("matched_id").isNotNull()).alias("in_library"))
