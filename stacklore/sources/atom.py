"""Preprint feeds in Atom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One paper per entry of the feeds in a folder."""
    return papers(spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path))


def entries(documents: DataFrame) -> DataFrame:
    """Entries of feeds that are texts (content)."""
    feed = F.from_xml(F.col("content"), f"entry array<struct<{', '.join(x.replace(' ', ':', 1) for x in ENTRY.split(', '))}>>")
    return documents.select(F.inline(feed["entry"]))


def papers(rows: DataFrame) -> DataFrame:
    """Papers of entries: white space of title and summary is collapsed, the version of the id is cut."""
    flat = lambda c: T.strip(F.regexp_replace(c, r"\s+", " "))
    key = T.arxiv_id(T.strip(F.col("id")))
    return rows.select(flat(F.col("title")).alias("title"), F.transform("author", lambda a: T.strip(a["name"])).alias("authors"), flat(F.col("summary")).alias("abstract_text"), F.substring("published", 1, 4).try_cast("int").alias("year"), key.alias("arxiv_id"), F.concat(F.lit("https://arxiv.org/abs/"), key).alias("url"))
