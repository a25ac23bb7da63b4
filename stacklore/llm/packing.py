"""Best-fit packing planned over a histogram of piece lengths."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode, little
from .common import SALTS, Scratch, read_table, slices, text_or_empty, texts_of

SIZE, END_ID = 1024, 2


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The token ids of each text and ``end_id``, cut into pieces of ``size``; only the first may be shorter."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 19):
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), encode(texts_of(batch.column(1)), vocabulary), strict=True):
                found += little([end_id])
                n = len(found) // 4
                at = 0
                for k, stop in enumerate(range((n - 1) % size + 1, n + 1, size)):
                    part = found[4 * at : 4 * stop]
                    rows.append((doc, k, at, stop - at, zlib.crc32(part), *([np.frombuffer(part, "<i4").tolist()] if ids else [])))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [x for x, _ in fields])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, kind)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Sequences with equal free space are one run of numbers, so the work and the plan
    depend on ``size`` and never on how many pieces there are. Each row (length, rank_from, rank_to, first_sequence,
    per_sequence, offset) puts those ranks of the length into consecutive sequences, ``per_sequence`` to each."""
    out: list[tuple[int, int, int, int, int, int]] = []
    free: list[int] = []  # the different free spaces, ascending
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def add(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in runs:
                insort(free, space)
            runs.setdefault(space, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], free[at]
            else:
                space, first = size, opened
                n = -(-left // (size // length))
                opened += n
            fit = space // length
            whole = min(n, left // fit)
            if whole:
                out.append((length, rank, rank + whole * fit, first, fit, size - space))
                rank, left = rank + whole * fit, left - whole * fit
                add(space - fit * length, first, whole)
            if left and whole < n:
                out.append((length, rank, rank + left, first + whole, left, size - space))
                add(space - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            add(space, first + whole, n - whole)
    return out


def pack(parts: DataFrame, scratch: Scratch, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...). Only the histogram, at most ``size`` rows,
    comes to the driver; the plan's runs are bounded by ``size`` as well. A piece finds its slot by its rank among the
    pieces of its length, counted in blocks (of n rows there are about sqrt(n) blocks of sqrt(n) rows), so that a length
    which a third of the pieces share is ranked by many tasks. A column ``lone`` spreads rows that share a doc_id, or have
    none, over blocks. Equal rows take any of their ranks."""
    spark, columns = parts.sparkSession, [c for c in parts.columns if c != "lone"]
    spread = ["doc_id", "piece", *(["lone"] if "lone" in parts.columns else [])]
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    blocks = spark.createDataFrame([(k, math.isqrt(n) + 1) for k, n in counts.items()], "length long, __blocks long")
    parts = parts.join(F.broadcast(blocks), "length").withColumn("__block", F.pmod(F.xxhash64(*spread), F.col("__blocks"))).drop("__blocks")
    sums = parts.groupBy("length", "__block").count()
    before = scratch.save(sums.select("length", "__block", (F.sum("count").over(Window.partitionBy("length").orderBy("__block")) - F.col("count")).alias("__before")), "ranks")
    rows = [(*row[:5], row[5]) for row in plan(counts, size)]
    slots = spark.createDataFrame(rows, "__length long, __from long, __to long, __first long, __per long, __offset long")
    inside = F.row_number().over(Window.partitionBy("length", "__block").orderBy(*spread)) - 1
    ranked = parts.withColumn("__rank", inside).join(before, ["length", "__block"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    fits = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    placed = ranked.join(F.broadcast(slots), fits)
    k = F.col("__rank") - F.col("__from")
    placed = placed.withColumn("sequence_id", F.col("__first") + F.floor(k / F.col("__per")).cast("long")).withColumn("offset", F.col("__offset") + k % F.col("__per") * F.col("length"))
    return placed.select(*columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, vocabulary: str, size: int = SIZE, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).
    Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows; other
    columns are not read. Null ids are kept."""
    scratch = Scratch(docs.sparkSession)
    number = F.monotonically_increasing_id()
    parts = pieces(docs, vocabulary, size, ids=ids).withColumn("lone", F.when(F.col("doc_id").isNull(), number).otherwise(number % SALTS))
    return pack(scratch.save(parts, "pieces"), scratch, size)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
