"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, cleared  # noqa: F401 -- for all operators

#: Rows of a lookup table that may be broadcast; above it the keyed join is shuffled and salted.
MAX_BROADCAST_ROWS = 10_000
SALTS = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value, body: Callable):
    """Evaluates ``value`` once per row and hands it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def keyed_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Joins a lookup table with one row per key, or few. It is broadcast only when counted to be small (``rows``, if the
    caller has counted it); else both sides are salted, so that a key with a third of all rows is spread over SALTS
    tasks."""
    if (small.count() if rows is None else rows) <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*big.columns[:3]), F.lit(SALTS)).cast("int")
    return big.withColumn("__salt", spread).join(salted, [*keys, "__salt"], how).drop("__salt")


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one slice holds at most ``most`` bytes of the column ``text`` (or one row)."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)
        del batch
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task; workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
