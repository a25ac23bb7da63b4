"""Benchmark decontamination: n-gram seeds, rare ones first, then Smith-Waterman alignment.

Documents are read once. A text that shares a seed with the benchmark is kept as word hashes, once for each block of
items that it shares one with; blocks then meet only those texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, slices, text_or_empty, texts_of
from .shingles import mix, word_hashes

WORD = re.compile(r"\w+")
#: Words of a seed; rows, share of all rows, and multiple of the item's own lower quartile up to which a seed is rare.
SEED, RARE_ROWS, RARE_SHARE, TIMES = 4, 100, 0.001, 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of the score of the whole item. Items shorter than MIN_WORDS have to be met whole.
SHARE, MIN_WORDS = 0.5, 12
#: Items of a seed up to which it proposes all of them; others propose the items of which a rarest word is there.
SEED_ITEMS = 32
#: Seeds of one block of the benchmark, which is aligned by itself, and of all blocks that one pass over documents seeks.
BLOCK_SEEDS, PASS_SEEDS = 500_000, 4_000_000


def hashed(texts: list[str]) -> list[np.ndarray]:
    """The words of each text, runs of letters, digits and underscores in lower case, as 64-bit hashes."""
    return word_hashes([" ".join(WORD.findall(x.lower())) for x in texts])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words. A hash only proposes; alignment decides."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix((out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first to before its last, one range after the other."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Items:
    """A block of benchmark items: word numbers, and the items and places of every seed. The seed of an item of fewer than
    SEED words is all of it.

    An item that has to meet a text in k of its m words meets it in one of any m - k + 1: it is listed under so many of its
    words, those of the fewest items. A phrase that most items share is not among them, unless it is k words itself."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        found = [(item, words) for (item, _), words in zip(rows, hashed([x or "" for _, x in rows]), strict=True) if len(words)]
        self.ids = [item for item, _ in found]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in found)]))
        self.words = [np.searchsorted(self.vocabulary, w) for _, w in found]
        keys = [grams(w, min(SEED, len(w))) for _, w in found]
        self.lengths = sorted({min(SEED, len(w)) for _, w in found})
        flat = np.concatenate([np.zeros(0, np.uint64), *keys])
        owner = np.repeat(np.arange(len(found)), [len(k) for k in keys]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k in keys)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.place = flat[order], owner[order], place[order]
        self.seeds, self.kind = np.unique(self.flat, return_inverse=True)
        self.listed = np.searchsorted(self.kind, np.arange(len(self.seeds) + 1))
        self.rare = np.ones(len(self.flat), bool)
        self.by_owner = np.argsort(self.owner, kind="stable")
        self.owned = np.searchsorted(self.owner[self.by_owner], np.arange(len(found) + 1))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = np.where(self.size >= MIN_WORDS, SHARE, 1.0)
        self.first = np.cumsum(self.size) - self.size
        self.flat_words = np.concatenate([np.zeros(0, np.int64), *self.words])
        holder = np.repeat(np.arange(len(found)), self.size)
        order = np.lexsort((np.bincount(self.flat_words, minlength=1)[self.flat_words], holder))
        least = np.ceil(self.need * self.size - 1e-9).astype(np.int64)
        order = order[ranges(self.first, self.first + self.size - least + 1)]
        order = order[np.argsort(self.flat_words[order], kind="stable")]
        self.under = holder[order]
        self.word_first = np.searchsorted(self.flat_words[order], np.arange(len(self.vocabulary) + 1))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Word numbers of hashes; -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seed numbers found in a text, given as hashes, and where."""
        seeds, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.lengths:
            key = grams(words, n)
            seed = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
            found = np.flatnonzero(self.seeds[seed] == key)
            seeds.append(seed[found])
            places.append(found)
        return np.concatenate(seeds), np.concatenate(places)

    def choose(self, counts: dict[int, int], rows: int) -> None:
        """Tells the rare seeds: those in at most RARE_ROWS rows, or RARE_SHARE of all, or TIMES as many rows as the lower
        quartile of the item's seeds. What they propose is aligned at once. Other seeds propose too, see ``align``."""
        df = np.array([counts.get(i, 0) for i in range(len(self.seeds))])[np.searchsorted(self.seeds, self.flat)]
        order = np.lexsort((df, self.owner))
        first, size = np.unique(self.owner[order], return_index=True, return_counts=True)[1:]
        quartile = np.zeros(len(self.ids))
        quartile[self.owner[order][first]] = df[order][first + size // 4]
        self.rare = df <= np.maximum(max(RARE_SHARE * rows, RARE_ROWS), TIMES * quartile[self.owner])

    def align(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, share, first word, word after the last) of each item's best alignment that reaches its share.

        Every seed proposes. Where no rare one does, the item's words in the passage are counted before it is aligned: a
        share needs as many matches, so that this loses nothing."""
        seed, at = self.hits(words)
        words = self.numbers(words)
        best: dict[int, tuple[int, float, int, int]] = {}
        if not len(seed):
            return []
        order = np.argsort(seed, kind="stable")
        seed, at = seed[order], at[order]
        present = np.zeros(len(self.vocabulary) + 1, bool)  # the last one is for unknown words, -1
        present[words] = True
        for owner in self.proposed(np.unique(seed), present).tolist():
            mine = self.by_owner[self.owned[owner] : self.owned[owner + 1]]
            lo, hi = np.searchsorted(seed, self.kind[mine]), np.searchsorted(seed, self.kind[mine], "right")
            start = at[ranges(lo, hi)] - np.repeat(self.place[mine], hi - lo)
            found, group = np.unique(start, return_inverse=True)
            rarely = np.bincount(group, np.repeat(self.rare[mine], hi - lo), len(found)) > 0
            m, need = int(self.size[owner]), float(self.need[owner])
            merged: list[list] = []
            for s, rare in zip(found.tolist(), rarely.tolist(), strict=True):
                if merged and s - m // 2 <= merged[-1][1]:
                    merged[-1][1:] = s + m + m // 2, merged[-1][2] or rare
                else:
                    merged.append([s - m // 2, s + m + m // 2, rare])
            for a, b, rare in merged:
                a = max(0, a)
                if not rare:
                    inside = np.zeros_like(present)
                    inside[words[a:b]] = True
                    if not self.enough(np.array([owner]), inside)[0]:
                        continue
                score, first, last = smith_waterman(self.words[owner], words[a:b])
                share = score / (MATCH * m)
                if share >= need and share > best.get(owner, (0, 0.0))[1]:
                    best[owner] = (self.ids[owner], share, a + first, a + last)
        return sorted(best.values())

    def proposed(self, seeds: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Items with one of the seeds and enough words present, found in a time that doesn't grow with the items of a seed."""
        few = self.listed[seeds + 1] - self.listed[seeds] <= SEED_ITEMS
        out = np.unique(self.owner[ranges(self.listed[seeds[few]], self.listed[seeds[few] + 1])])
        if not few.all():
            seen = np.flatnonzero(present[:-1])
            out = np.union1d(out, self.under[ranges(self.word_first[seen], self.word_first[seen + 1])])
        return out[self.enough(out, present)]

    def enough(self, owners: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Whether so many of each item's words are present that its share could be reached."""
        if not len(owners):
            return np.zeros(0, bool)
        size = self.size[owners]
        words = self.flat_words[ranges(self.first[owners], self.first[owners] + size)]
        return np.add.reduceat(present[words], np.cumsum(size) - size, dtype=np.int64) >= self.need[owners] * size


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and where it begins and ends in the passage. Row by row; gaps along a row are a
    running maximum. Each cell carries the start of its alignment."""
    n = len(passage)
    if not n:
        return 0, 0, 0
    place = np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), place.copy()
    top = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        now, came = score + GAP, begin.copy()
        diagonal = score[:-1] + step
        take = diagonal >= now[1:]
        now[1:][take], came[1:][take] = diagonal[take], begin[:-1][take]
        low = now <= 0
        now[low], came[low] = 0, place[low]
        lifted = now - GAP * place
        peak = np.maximum.accumulate(lifted)
        holder = np.maximum.accumulate(np.where(lifted == peak, place, 0))
        along = peak + GAP * place
        better = along > now
        now[better], came[better] = along[better], came[holder[better]]
        k = int(now.argmax())
        if now[k] > top[0]:
            top = (int(now[k]), int(came[k]), k)
        score, begin = now, came
    return top


def blocks_of(benchmark: DataFrame) -> Iterator[Items]:
    rows, seeds = [], 0
    for item, text in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((item, text))
        seeds += len(text or "") // 4
        if seeds > BLOCK_SEEDS:
            yield Items(rows)
            rows, seeds = [], 0
    if rows:
        yield Items(rows)


def passes(blocks: Iterator[Items]) -> Iterator[list[Items]]:
    held, seeds = [], 0
    for items in blocks:
        held.append(items)
        seeds += len(items.seeds)
        if seeds > PASS_SEEDS:
            yield held
            held, seeds = [], 0
    if held:
        yield held


#: Columns of a result besides doc_id.
SPANS = "item_id long, share double, first_word long, last_word long"
KINDS = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
NAMES = ["doc_id", "item_id", "share", "first_word", "last_word"]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share, first_word, last_word: each row of documents with each item of which it holds a copy.

    Words are runs of letters, digits and underscores in lower case. Null and empty texts and items match nothing;
    repeated rows give repeated results; empty tables give none; other columns are not read. doc_id may be a number or a
    digest. The benchmark is the stated query set: it goes to the executors in blocks of bounded size, and one pass over
    documents, and one over the texts met, serves PASS_SEEDS."""
    spark, scratch, out = docs.sparkSession, Scratch(docs.sparkSession), None
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    name, id_kind = ("binary", pa.binary()) if name == "binary" else ("long", pa.int64())
    rows, total = rows.withColumn("doc_id", F.col("doc_id").cast(name)), None
    for k, blocks in enumerate(passes(blocks_of(benchmark))):

        def seek(batches: Iterator[pa.RecordBatch], blocks: list[Items] = blocks) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, 1 << 19):
                found = []
                for doc, words in zip(batch.column(0).to_pylist(), hashed(texts_of(batch.column(1))), strict=True):
                    for b, items in enumerate(blocks):
                        if len(seed := np.unique(items.hits(words)[0])):
                            found.append((b, doc, words.view(np.int64), seed))
                kinds = (pa.int32(), id_kind, pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["block", "doc_id", "words", "seeds"])

        met = scratch.save(rows.mapInArrow(seek, f"block int, doc_id {name}, words array<long>, seeds array<long>"), f"seeds{k}", "block")
        total = docs.count() if total is None else total
        counts = met.select("block", F.explode("seeds").alias("seed")).groupBy("block", "seed").count().orderBy("block")
        for b, found in groupby(counts.toLocalIterator(), lambda r: r["block"]):
            blocks[b].choose({r["seed"]: r["count"] for r in found}, total)

        def align(batches: Iterator[pa.RecordBatch], blocks: list[Items] = blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True)
                found = [(doc, *x) for b, doc, words in rows for x in blocks[b].align(words.values.to_numpy().view(np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((id_kind, *KINDS))], NAMES)

        hits = met.select("block", "doc_id", "words").mapInArrow(align, f"doc_id {name}, {SPANS}")
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], f"doc_id {name}, {SPANS}") if out is None else out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
