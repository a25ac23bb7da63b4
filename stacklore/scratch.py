"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_clearing: list[list[Scratch]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes at its end what is left of all tables that were saved inside, for callers that have written their result."""
    made: list[Scratch] = []
    _clearing.append(made)
    try:
        yield
    finally:
        _clearing.remove(made)
        for scratch in made:
            scratch.keep()


#: Rows that pass between Spark and Python at a time while a table is made; texts make wide rows.
ARROW_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_ROWS) -> Iterator[None]:
    """Arrow batches of ``most`` rows at most, for what is executed inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared checkpoint folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, arrow_rows: int = ARROW_ROWS) -> None:
        self.spark, self.names, self.arrow_rows = spark, set(), arrow_rows
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="stacklore-")
        if _clearing:
            _clearing[-1].append(self)
        self.root = f"{base.rstrip('/')}/stacklore-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """Writes a table, with one folder for each value of the columns ``folders``, and reads it again."""
        path = f"{self.root}/{name}"
        with small_batches(self.spark, self.arrow_rows):
            df.write.mode("overwrite").partitionBy(*folders).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in self.names.intersection(names):
            file = path(f"{self.root}/{name}")
            file.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(file, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which a result still reads."""
        self.drop(*self.names.difference(names))
