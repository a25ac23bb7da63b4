"""Page texts of PDF files. Extraction itself needs a library that isn't part of this one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def papers_and_bodies(pages: DataFrame) -> DataFrame:
    """pages (file, page, text) to file, title, abstract_text, body. The title is the file's name; the abstract comes
    from the text without page marks."""
    texts = pages.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]).alias("pages"))
    name = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[pP][dD][fF]$", "")
    return texts.select("file", name.alias("title"), T.abstract_from_body(F.array_join("pages", "\n")).alias("abstract_text"), T.prepare_body(T.join_pages(F.col("pages"))).alias("body"))
