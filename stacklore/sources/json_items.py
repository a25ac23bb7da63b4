"""Items of large JSON arrays, read by many tasks.

A file is split at closing braces, which Spark's text reader finds in any part of it. What a part means depends on all
before it: whether it begins inside a string is the parity of the quotes before it, and how deep it lies is a sum too.
So running sums, within a file's blocks and over blocks, tell where items end; no task reads a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import json_sources

#: Bytes from which a file is read by many tasks.
LARGE = 64 << 20


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier parts of the file: over earlier blocks, and within the block."""
    rows = rows.withColumn("__value", value.cast("long"))
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("__value").alias("__sum")).select("file", "block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return rows.join(blocks, ["file", "block"]).withColumn(name, F.col("__inside") + F.col("__before")).drop("__value", "__inside", "__before")


def _count(text: Column, *signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, "".join(signs), ""))


def read_items(spark: SparkSession, paths: str | list[str], scratch: Scratch | None = None) -> DataFrame:
    """file, item (from 0), content, error of the items of JSON arrays, one row each. What isn't an object, and the rest of
    a file that doesn't end as an array, has an error; a file without an item and without one is an empty array and gives
    no row."""
    scratch = scratch or Scratch(spark)
    parts = spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    parts = scratch.save(parts, "parts")
    clean = F.regexp_replace("text", r"(?s)\\.", "")
    rows = _running(parts.withColumn("clean", clean).withColumn("quotes", _count(F.col("clean"), '"')), F.col("quotes"), "quoted")
    outside = F.when(F.col("quoted") % 2 == 1, F.regexp_replace("clean", '^[^"]*("|$)', "")).otherwise(F.col("clean"))
    rows = rows.withColumn("outside", F.regexp_replace(outside, '"[^"]*("|$)', "")).withColumn("ends_outside", (F.col("quoted") + F.col("quotes")) % 2 == 0)
    step = _count(F.col("outside"), "{", "[") - _count(F.col("outside"), "]")
    rows = rows.withColumn("step", step - F.col("ends_outside").cast("int"))
    rows = scratch.save(_running(rows, F.col("step"), "depth").select("file", "block", "n", "text", (F.col("ends_outside") & (F.col("depth") + F.col("step") == 1)).alias("ends")), "depths")
    rows = _running(rows, F.col("ends"), "item")
    found = rows.groupBy("file", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]), "}").alias("text"), F.bool_or("ends").alias("whole"))
    found = found.withColumn("begins", F.when(F.col("item") == 0, F.col("text").rlike(r"^\s*\[")).otherwise(F.col("text").rlike(r"^\s*,")))
    content = F.concat(F.regexp_replace("text", r"^\s*[\[,]\s*", ""), F.lit("}"))
    of_object = F.coalesce(F.schema_of_variant(F.try_parse_json(content)).startswith("OBJECT"), F.lit(False))
    last = F.when(F.col("item") == 0, F.col("text").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$"))
    error = F.when(~F.col("whole"), F.when(~last, "the array doesn't end here, or ends with another item")).when(~(F.col("begins") & of_object), "not an object")
    out = found.select("file", "item", F.when(F.col("whole"), content).alias("content"), error.alias("error")).where("content is not null or error is not null")
    # an array that is cut right behind an item has no rest
    ends = found.groupBy("file").agg(F.bool_or(~F.col("whole")).alias("rest"), F.max("item").alias("item")).where("not rest")
    rest = F.lit(None).cast("string").alias("content"), F.lit("the array doesn't end").alias("error")
    return out.unionByName(ends.select("file", (F.col("item") + 1).alias("item"), *rest))


def failures(items: DataFrame) -> DataFrame:
    """file, item, error of what can't be read."""
    return items.where("error is not null").select("file", "item", "error")


def bibliography(items: DataFrame) -> DataFrame:
    """Papers of items of either dialect, which a file's first item tells; a file with an item that can't be read gives
    nothing, as in ``json_sources.bibliography``."""
    good = items.join(items.where("error is not null").select("file").distinct(), "file", "left_anti")
    one = good.select("file", F.concat(F.lit("["), "content", F.lit("]")).alias("content"), "item")
    dialect = one.where("item = 0").select("file", json_sources.is_zotero(F.col("content")).alias("zotero"))
    one = one.join(dialect, "file").drop("item")
    return json_sources.csl(one.where("not zotero").drop("zotero")).unionByName(json_sources._zotero(one.where("zotero").drop("zotero")))
