"""Removal of long repeated byte strings by sorted suffixes.

A suffix matters here by its first ``length`` bytes, its window. Windows are grouped by a leading token, an anchor: of
all strings of CORE bytes inside the window the one of least hash, so that equal windows have equal anchors at equal
places, and about 77 neighbouring windows share one anchor. Anchors that only one text has, once, are ruled out. The
windows of the others are sorted in range partitions of the anchors, and compared with their neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, read_table, slices, text_or_empty

LENGTH, CORE = 200, 48
#: Windows that begin in one stretch of a text are hashed together.
STRETCH = 1 << 19
#: Anchored contexts that are sorted together; a larger group is compared across the parts it is cut into.
GROUP = 16_000
#: Rows that pass between Spark and Python at a time; most are narrow, an anchor and a digest.
ARROW_ROWS = 10_000
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n, np.uint64)
    down = np.empty(n, np.uint64)
    up[:] = BASE
    down[:] = pow(BASE, -1, 1 << 64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_kept: dict[str, tuple] = {}


def anchors(data: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(hash, place, first, windows) of each anchor of a byte string: ``windows`` windows from ``first`` on have their
    anchor at ``place``. Each window has one."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    if "powers" not in _kept or len(_kept["powers"][0]) < len(data):
        _kept["powers"] = _powers(max(len(data), 1 << 16))
    up, down = (x[: len(data)] for x in _kept["powers"])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = (sums[core:] - sums[:-core]) * down[: len(data) - core + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    # least of each span of ``wide`` cores, the first of equals: least up to here from the block's begin, and from here to its end
    wide, bits = length - core + 1, np.uint64(20)
    values = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(values) // wide)
    padded = np.full(blocks * wide, ~np.uint64(0))
    padded[: len(values)] = values
    padded = padded.reshape(blocks, wide)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return hashes[at[first]].view(np.int64), at[first], first, np.diff(np.concatenate((first, [n])))


def stretches(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that share length - 1 bytes, so that each window begins in one part."""
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, max(len(data) - length + 1, 0), STRETCH):
        yield begin, data[begin : begin + STRETCH + length - 1]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first counting most; zeros follow the last byte."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def multikey_sort(words: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes by group and bytes as multikey quicksort does, all parts at a time: each part of suffixes that
    agree so far is ordered by their next eight bytes and split where these differ; parts of one suffix are done. Gives
    (place in ``starts``, number of the part) of the suffixes that equal another in ``length`` bytes, part by part."""
    rows = np.argsort(groups, kind="stable")
    part = groups[rows]
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for step in [None, *steps]:
        if step is not None:
            key = words[starts[rows] + step]
            order = np.lexsort((key, part))
            rows, part, key = rows[order], part[order], key[order]
        new = np.ones(len(rows), bool)
        new[1:] = part[1:] != part[:-1]
        if step is not None:
            new[1:] |= key[1:] != key[:-1]
        alone = new & np.concatenate((new[1:], [True]))
        part = np.cumsum(new)
        rows, part = rows[~alone], part[~alone]
        if not len(rows):
            break
    return rows, part


FOUND = "doc binary, start long, stop long, window binary"
CONTEXT = "anchor long, doc binary, first long, place int, windows int, context binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc", "start", "stop", "window"])


def _bucket(group: pa.Table, opened: bool, length: int) -> Iterator[pa.RecordBatch]:
    """Compares the windows of some contexts (whole groups of one anchor each). A context that is there twice is repeated
    as a whole; of each of the others the outermost repeated windows tell what is covered, as all its windows overlap.
    Of an ``opened`` group, one that goes on in other parts, one window of each kind is told as well. A row without a
    context is one more copy within its text."""
    without = pc.is_null(group.column("context"))
    lone, group = group.filter(without), group.filter(pc.invert(without))
    if lone.num_rows:
        yield _found([(d, a, a + n + length - 1, None) for d, a, n in zip(*(lone.column(c).to_pylist() for c in ("doc", "first", "windows")), strict=True)])
    if not group.num_rows:
        return
    docs, firsts, contexts = group.column("doc").to_pylist(), group.column("first").to_pylist(), group.column("context").to_pylist()
    keys = list(zip(group.column("anchor").to_pylist(), group.column("place").to_pylist(), contexts, strict=True))
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault(k, len(kinds)) for k in keys]
    many = np.bincount(kind) > 1
    rows = [(docs[i], firsts[i], firsts[i] + len(contexts[i]), None) for i in range(len(docs)) if many[kind[i]]]
    owner = [0] * len(kinds)
    for i, k in enumerate(kind):
        owner[k] = i
    sizes = np.array([len(k[2]) for k in kinds])
    counts = sizes - length + 1
    buffer = np.frombuffer(b"".join(k[2] for k in kinds), np.uint8)
    ends = np.cumsum(sizes)
    context = np.repeat(np.arange(len(kinds)), counts)
    inside = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (ends - sizes)[context] + inside
    # equal windows have equal anchors at equal distances
    anchor = np.unique(np.array([k[0] for k in kinds], np.int64), return_inverse=True)[1]
    distance = np.array([k[1] for k in kinds])[context] - inside
    same, part = multikey_sort(_words(buffer), starts, anchor[context] * length + distance, length)
    low, high = np.full(len(kinds), 1 << 40), np.full(len(kinds), -1)
    np.minimum.at(low, context[same], inside[same])
    np.maximum.at(high, context[same], inside[same])
    for k in np.flatnonzero((high >= 0) & ~many):
        i = owner[k]
        rows.append((docs[i], firsts[i] + int(low[k]), firsts[i] + int(high[k]) + length, None))
    if rows:
        yield _found(rows)
    if opened:
        first_of_part = np.ones(len(same), bool)
        first_of_part[1:] = part[1:] != part[:-1]
        told = np.ones(len(starts), bool)
        told[same[~first_of_part]] = False
        raw = buffer.tobytes()
        rows = []
        for w in np.flatnonzero(told):
            k, at = int(context[w]), int(starts[w])
            begin = firsts[owner[k]] + int(inside[w])
            rows.append((docs[owner[k]], begin, begin + length, hashlib.blake2b(raw[at : at + length], digest_size=16).digest()))
            if len(rows) == 20_000:
                yield _found(rows)
                rows = []
        if rows:
            yield _found(rows)


def _compare(length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, so many that a bucket is of bounded size. The first and the last group of a partition may go on in
        its neighbours, and one that is too large is cut; these are opened."""
        held, edge = None, True
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows:
                anchor = held.column("anchor").to_numpy()
                last = int(np.searchsorted(anchor, anchor[-1]))  # where the last group, which isn't complete, begins
                first = int(np.searchsorted(anchor, anchor[0], side="right"))
                if edge and last:
                    yield from _bucket(held.slice(0, first), True, length)
                    held, edge = held.slice(first), False
                elif last and held.num_rows >= most // 4:
                    yield from _bucket(held.slice(0, last), False, length)
                    held = held.slice(last)
                elif not last and held.num_rows >= most:
                    yield from _bucket(held, True, length)
                    held, edge = held.slice(held.num_rows), True
                else:
                    break
        if held is not None and held.num_rows:
            anchor = held.column("anchor").to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                yield from _bucket(held.slice(0, last), edge, length)
            yield from _bucket(held.slice(last), True, length)
        give_back()

    return run


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a column of numbers or digests differs from the row before, from the second row on."""
    if pa.types.is_integer(column.type):
        x = column.to_numpy()
        return x[1:] != x[:-1]
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), 2)
    return (x[1:] != x[:-1]).any(axis=1)


def _runs(key: str, value: list[str], flag: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key has different values, or a flag, in this partition; those of the first and the last key in any
        case, marked as edges."""
        held, first = None, True
        for batch in _then_none(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            new = np.concatenate(([True], _changes(held.column(key))))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.concatenate((starts, [held.num_rows])))
            differs = np.zeros(held.num_rows, bool)
            for c in value:
                differs[1:] |= _changes(held.column(c))
            differs &= ~new
            if flag:
                differs |= held.column(flag).to_numpy()
            more, edge = np.logical_or.reduceat(differs, starts), np.zeros(len(starts), bool)
            edge[0], edge[-1] = first, batch is None
            done = len(starts) if batch is None else len(starts) - 1
            if done:
                told = np.repeat((more | edge)[:done], sizes[:done])
                out = held.slice(0, int(sizes[:done].sum())).filter(pa.array(told))
                marks = np.repeat(edge[:done], sizes[:done])[told]
                yield from out.append_column("edge", pa.array(marks)).to_batches()
                held, first = held.slice(int(sizes[:done].sum())), False
        give_back()

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def neighbours(rows: DataFrame, key: str, value: list[str], scratch: Scratch, name: str, flag: str | None = None) -> DataFrame:
    """The rows whose key has more than one value, or a flag. Rows are sorted by ranges of key and value and compared with
    their neighbours, so a key that a third of all rows have lies in many partitions; the first and the last key of each
    partition, two of each, are compared across its edges."""
    rows = scratch.save(rows, f"{name}_rows")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    told = scratch.save(rows.repartitionByRange(key, *value).sortWithinPartitions(key, *value).mapInArrow(_runs(key, value, flag), f"{kind}, edge boolean"), f"{name}_told")
    v = F.struct(*value)
    more = F.min(v) != F.max(v)
    keys = told.where("edge").groupBy(key).agg((more | F.bool_or(flag) if flag else more).alias("more")).where("more").select(key)
    return told.where("not edge").drop("edge").unionByName(told.where("edge").drop("edge").join(F.broadcast(keys), key, "left_semi"))


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, most: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Of texts (doc: a digest, text) with copies: the distinct texts that may hold repeats, and the spans of bytes (doc,
    start, stop) that repeat in them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hashes, docs, twice = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = [anchors(data, length)[0] for _, data in stretches(text, length)]
                if mine:
                    found, n = np.unique(np.concatenate(mine), return_counts=True)
                    hashes.append(found)
                    twice.append(n > 1)
                    docs += [doc] * len(found)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(docs, pa.binary()), pa.array(np.concatenate(twice))], ["anchor", "doc", "twice"])
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["anchor", "doc", "first", "place", "windows", "context"])
        for batch in slices(batches, 1, 1 << 19):
            rows: list[tuple] = []
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                wanted = np.array(wanted, np.int64)
                for begin, data in stretches(text, length):
                    hashes, at, first, n = anchors(data, length)
                    seen: dict[tuple, int] = {}
                    for i in np.flatnonzero(np.isin(hashes, wanted)):
                        a, b = int(first[i]), int(n[i])
                        context = text[begin + a : begin + a + b + length - 1]
                        key = (int(hashes[i]), int(at[i]) - a, context)
                        seen[key] = seen.get(key, 0) + 1
                        rows.append((key[0], doc, begin + a, key[1], b, context if seen[key] < 3 else None))
                        if len(rows) == 10_000:
                            yield table(rows)
                            rows = []
            if rows:
                yield table(rows)
        give_back()

    found = texts.where(F.octet_length("text") >= length).mapInArrow(find, "anchor long, doc binary, twice boolean")
    shared = neighbours(found, "anchor", ["doc"], scratch, "anchors", "twice").select("doc", "anchor").distinct()
    wanted = scratch.save(shared.groupBy("doc").agg(F.collect_list("anchor").alias("wanted")), "wanted")
    scratch.drop("anchors_rows", "anchors_told")
    distinct = texts.where(F.octet_length("text") >= length).groupBy("doc").agg(F.first("text").alias("text"))
    candidates = scratch.save(distinct.join(wanted, "doc"), "candidates")
    contexts = scratch.save(candidates.select("doc", "text", "wanted").mapInArrow(cut, CONTEXT), "contexts")
    sorted_contexts = contexts.repartitionByRange("anchor", "doc", "first").sortWithinPartitions("anchor")
    spans = scratch.save(sorted_contexts.mapInArrow(_compare(length, most), FOUND), "spans")
    scratch.drop("contexts", "wanted")
    opened = neighbours(spans.where("window is not null").select("window", "doc", "start", "stop"), "window", ["doc", "start"], scratch, "opened").select("doc", "start", "stop")
    return candidates, spans.where("window is null").select("doc", "start", "stop").unionByName(opened)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, most: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop: maximal runs of removed bytes), kept (the other bytes; null where nothing is
    removed) and sha256 (of the text) for each row. A byte is removed if a string of ``length`` bytes that covers it begins
    at another place too, in the same or another row.

    Copies of a whole text are counted and compared once: of ``length`` bytes or more, nothing of them is kept. Null text
    counts as empty; shorter texts are kept; repeated rows and null ids stay; an empty table gives no rows; other columns
    are not read. Runs of an anchor or a window that a third of all rows share lie in many partitions, which are compared
    at their edges; a task holds ``most`` contexts at a time. Copied texts with more than a thousandth of all rows, a
    thousand at most, are joined by broadcast, the others by shuffle."""
    scratch = Scratch(docs.sparkSession, ARROW_ROWS)
    text = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha256"), text.alias("text"))
    rows = rows.select("doc_id", "sha256", F.substring("sha256", 1, 16).alias("doc"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    candidates, spans = repeated_spans(rows.select("doc", "text"), scratch, length, most)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            merged, kept = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((x["start"], x["stop"]) for x in found):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                merged.append([{"start": a, "stop": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["doc", "spans", "kept"])
        give_back()

    mine = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    cleaned = candidates.select("doc", "text").join(mine, "doc").mapInArrow(remove, "doc binary, spans array<struct<start:long,stop:long>>, kept binary")
    rows = rows.drop("text")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("doc").agg(F.count("*").alias("copies")).where("copies > 1")
    whole = F.col("copies").isNotNull()
    told = cleaned.join(copies, "doc", "full").select("doc", "copies", F.when(~whole, F.col("spans")).alias("spans"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    told = scratch.save(told, "told")
    often = told.where(F.col("copies") > docs.count() / 1000)
    rows = rows.join(F.broadcast(often.select("doc", F.lit(True).alias("hot"))), "doc", "left")
    hot, rest = rows.where("hot").join(F.broadcast(often), "doc"), rows.where("hot is null").join(told, "doc", "left")
    done = hot.unionByName(rest)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    scratch.keep("told")
    return done.select("doc_id", "n_bytes", F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"), "kept", "sha256")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), F.lower(F.hex("sha256"))).alias("kept_sha256"))
