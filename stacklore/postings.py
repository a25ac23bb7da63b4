"""A word index of texts that follows its table by segments.

A query's term has no white space, so a text holds it where one of its words does: the postings of the words that hold a
term are those of the term. Postings stand in blocks of documents of like size; the head of a block tells how often the
word occurs in a document at most and how small one is, which bounds the score of all of them. A task that reads texts
makes blocks of them, so the index is built without a shuffle.

A segment holds the words of what one or more batches changed, what these replace as postings of sign -1, and the ids.
A document's newest segment counts. Small segments are merged with small ones, so that a row is rewritten a few times
however many batches come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog, Conflict
from .operators import search
from .scratch import Scratch, small_batches

#: Documents of a block, blocks that are read at first, segments of like size that are merged.
BLOCK, FIRST, FAN_IN = 1024, 32, 4
#: Blocks of a task's own rows may be small: the first round reads so many times more.
WIDER = 4
#: Bytes of text that make a block, and rows that pass to Python at a time.
TEXT, ROWS = 8 << 20, 128
#: A posting is a document's place in its block, in the upper half, and how often it holds the word. Ids and sizes stand once
#: for each block, in a row without a token.
BLOCKS = "token string, sign int, block long, n long, max_tf long, min_size int, docs array<long>, ids array<string>, sizes array<int>"


def invert(batches: Iterable[pa.RecordBatch], most: int, nbytes: int) -> Iterator[pa.RecordBatch]:
    """BLOCKS of the rows (id, sign, size, text, tfs) of a task, which come by sign and size. A block ends after ``most``
    documents, after half of them where a size is twice the least, or after ``nbytes`` bytes of text, which bound the memory."""
    made, held, n, total, sign, least = TaskContext.get().partitionId() << 32, [], 0, 0, None, 0
    for batch in batches:
        begin, rows = 0, zip(batch["sign"].to_pylist(), batch["size"].to_pylist(), pc.binary_length(batch["text"]).to_pylist(), strict=True)
        for i, (s, size, length) in enumerate(rows):
            if n and (s != sign or n == most or total + length > nbytes or 2 * n >= most and size > 2 * least + 1):
                yield _block([*held, batch.slice(begin, i - begin)], made)
                made, held, n, total, begin = made + 1, [], 0, 0, i
            sign, least, n, total = s, least if n else size, n + 1, total + length
        held.append(batch.slice(begin))
    if n:
        yield _block(held, made)


def _block(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    """The block's row, which has no token, then one for each word of three or more characters."""
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, size, text, tfs = (rows[x].combine_chunks() for x in ("id", "size", "text", "tfs"))
    parts = pc.ascii_split_whitespace(pc.replace_substring(text, "\x00", " "))
    each, doc = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    long = pc.greater_equal(pc.utf8_length(each), 3)
    coded, doc = each.filter(long).dictionary_encode(), doc[long.to_numpy(zero_copy_only=False)]
    pairs = coded.indices.to_numpy().astype("int64") * len(rows) + doc
    if tfs.null_count:
        pairs, tf = np.unique(pairs, return_counts=True)
    else:
        order = np.argsort(pairs)
        pairs, tf = pairs[order], pc.list_flatten(tfs).to_numpy()[order]
    token, doc = np.divmod(pairs, len(rows))
    starts = np.flatnonzero(np.diff(token, prepend=-1))
    ends = np.append(starts, len(token))
    of = lambda f, values: f.reduceat(values, starts) if len(starts) else values
    first = lambda head, tail, kind: pa.array(np.append(head, tail), kind)
    same = lambda value, kind: pa.array(np.full(len(starts) + 1, value), kind)
    once = lambda values: pa.array([values.to_pylist(), *[None] * len(starts)], pa.list_(values.type))
    out = {
        "token": pa.concat_arrays([pa.array([""]), coded.dictionary]), "sign": same(rows["sign"][0].as_py(), pa.int32()), "block": same(block, pa.int64()),
        "n": first(len(rows), np.diff(ends), pa.int64()), "max_tf": first(0, of(np.maximum, tf), pa.int64()), "min_size": first(0, of(np.minimum, size.to_numpy()[doc]), pa.int32()),
        "docs": pa.ListArray.from_arrays(first(0, ends, pa.int32()), pa.array(doc << 32 | tf)), "ids": once(ids), "sizes": once(size),
    }
    return pa.RecordBatch.from_pydict(out)


def _dealt(rows: DataFrame) -> DataFrame:
    """BLOCKS of (id, sign, size, text, tfs). A task makes blocks of its own rows, in order of size, so that neither texts nor
    words are shuffled."""
    rows = rows.select("id", "sign", F.col("size").cast("int").alias("size"), "text", "tfs")
    return rows.sortWithinPartitions("sign", "size").mapInArrow(partial(invert, most=BLOCK, nbytes=TEXT), BLOCKS).sortWithinPartitions("token", "block")


def blocks(now: DataFrame, before: DataFrame | None, fields: tuple[str, ...]) -> DataFrame:
    """BLOCKS of the words of rows (id, fields)."""
    rows = search.searched_text(now, fields).withColumn("sign", F.lit(1))
    if before is not None:
        rows = rows.unionByName(search.searched_text(before, fields).withColumn("sign", F.lit(-1)))
    return _dealt(rows.withColumn("tfs", F.lit(None).cast("array<long>")))


def counted(postings: DataFrame) -> DataFrame:
    """BLOCKS of (id, token, tf, size, sign)."""
    words = F.collect_list(F.struct("token", F.col("tf").cast("long").alias("tf"))).alias("words")
    rows = postings.groupBy("id", "size", "sign").agg(words)
    return _dealt(rows.select("id", "size", "sign", F.array_join("words.token", " ").alias("text"), F.col("words.tf").alias("tfs")))


def located(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, _order, block, doc and tf of postings: ``doc`` is a document's place in its block."""
    each = rows.select(*kept, "_order", "block", F.explode("docs").alias("d"))
    return each.select(*kept, "_order", "block", F.shiftright("d", 32).cast("int").alias("doc"), F.col("d").bitwiseAND(0xFFFFFFFF).alias("tf"))


def members(rows: DataFrame) -> DataFrame:
    """_order, block, doc, id, size: what stands in the blocks."""
    heads = rows.where("token = ''").select("_order", "block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "d"))
    return heads.select("_order", "block", "doc", F.col("d.ids").alias("id"), F.col("d.sizes").alias("size"))


class WordIndex:
    def __init__(self, spark: SparkSession, root: str, fields: tuple[str, ...]) -> None:
        self.spark, self.log, self.fields = spark, CommitLog(spark, root), fields

    def state(self) -> dict | None:
        """The last segment's entry: which version of its table the index follows, and the numbers of its rows."""
        found = self.log.live()
        return max(found, key=lambda x: x["follows"]) if found else None

    def build(self, rows: DataFrame, follows: int) -> None:
        """One segment of all rows, in place of what there is."""
        self._add(rows, None, rows.select("id"), follows, {"n": 0, "size": 0}, self.log.version(), self.log.live())

    def add(self, now: DataFrame, before: DataFrame, ids: DataFrame, follows: int) -> None:
        """A segment of a change: the present rows and the former ones of ``ids``. Raises Conflict if another was faster."""
        version, state = self.log.version(), self.state()
        self._add(now, before, ids, follows, state, version, None)
        self.merge()

    def _add(self, now: DataFrame, before: DataFrame | None, ids: DataFrame, follows: int, state: dict, version: int, replaces: list[dict] | None) -> None:
        with small_batches(self.spark, ROWS):
            folder = self.log.write(blocks(now, before, self.fields), compression="zstd")
        docs = self.log.write(ids.select("id").distinct())
        # what the blocks hold is counted, so that texts are read once
        sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)
        held = self.log.folder(folder).where("token = ''").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(sizes * F.col("sign")).alias("size"))
        change = held.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("size", F.lit(0)).alias("size")).first()
        facts = {"docs": docs, "follows": follows, "rows": self.log.folder(docs).count(), "n": state["n"] + int(change["n"]), "size": state["size"] + int(change["size"])}
        try:
            self.log.commit(folder, version, replaces, **facts)
        except Conflict:
            self.log.discard(folder, docs)
            raise

    def merge(self) -> bool:
        """Merges the newest segments if FAN_IN or more are of like size. Of a document its newest postings stay, and what
        its oldest change in these segments replaced before them."""
        segments = self.log.live()
        tail = segments[-1:]
        while len(tail) < len(segments) and segments[-len(tail) - 1]["rows"] <= 2 * sum(x["rows"] for x in tail):
            tail = segments[-len(tail) - 1 :]
        if len(tail) < FAN_IN:
            return False
        first, last, version = tail[0]["order"], tail[-1], self.log.version()
        of = lambda column: self.log.read(after=first - 1, column=column)
        spans = of("docs").groupBy("id").agg(F.min("_order").alias("oldest"), F.max("_order").alias("newest"))
        rows = located(of("folder").where("token <> ''"), "token", "sign").join(members(of("folder")), ["_order", "block", "doc"])
        kept = rows.join(spans, "id").where(F.when(F.col("sign") > 0, F.col("_order") == F.col("newest")).otherwise((F.col("_order") == F.col("oldest")) & F.lit(len(tail) < len(segments))))
        with small_batches(self.spark, ROWS):
            folder = self.log.write(counted(kept.select("token", "id", "tf", "size", "sign")), compression="zstd")
        docs = self.log.write(spans.select("id"))
        facts = {"docs": docs, "follows": last["follows"], "rows": self.log.folder(docs).count(), "n": last["n"], "size": last["size"]}
        try:
            self.log.commit(folder, version, tail, last["order"], **facts)
        except Conflict:
            self.log.discard(folder, docs)
            return False
        return True

    def counts(self, heads: DataFrame, terms: list[str], at: int) -> list[int]:
        """In how many documents each term is: from the heads where one word of a block holds it, else from the ids."""
        groups = heads.groupBy("term", "_order", "block", "sign").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
        few = groups.where("words = 1").select("term", (F.col("n") * F.col("sign")).alias("n"))
        many = heads.join(groups.where("words > 1").select("term", "_order", "block", "sign"), ["term", "_order", "block", "sign"], "left_semi").select("term", "token", "_order", "block", "sign")
        docs = located(self._holding(terms, at), "token", "sign").join(many, ["token", "_order", "block", "sign"])
        many = docs.select("term", "_order", "block", "sign", "doc").distinct().select("term", F.col("sign").cast("long").alias("n"))
        found = {r["term"]: r["n"] for r in few.unionByName(many).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return [int(found.get(i, 0)) for i in range(len(terms))]

    def _holding(self, terms: list[str], at: int) -> DataFrame:
        return self.log.read(at).where(reduce(Column.__or__, [F.col("token").contains(t) for t in terms]))

    def top(self, query: str, k: int, wanted: Callable[[DataFrame], DataFrame] = lambda rows: rows, told: dict | None = None) -> DataFrame:
        """id, rank of the k best documents that hold all terms, of those that ``wanted`` leaves of rows with an id: equal
        to ``search.top`` over all rows. Blocks are read in two rounds: those of the highest bounds, then all whose bound
        isn't below the k-th best score found; no other can hold a better document. ``told`` gets the numbers of blocks."""
        terms, at = search.query_terms(query), self.log.version()
        state = self.state()
        if not terms or not state["n"]:
            return self.spark.createDataFrame([], "id string, rank double")
        scratch = Scratch(self.spark)
        hits = F.filter(F.array(*[F.struct(F.lit(i).alias("term"), search.occurrences(F.col("token"), t).cast("long").alias("occ")) for i, t in enumerate(terms)]), lambda x: x["occ"] > 0)
        heads = self._holding(terms, at).select("token", "sign", "_order", "block", "n", "max_tf", "min_size", F.inline(hits))
        heads = scratch.save(heads, "heads")
        mean = state["size"] / state["n"]
        inverse = [F.log((F.lit(float(state["n"])) - df + 0.5) / (F.lit(float(df)) + 0.5)) for df in self.counts(heads, terms, at)]
        weigh = lambda i, f, size: F.when(inverse[i] <= 0, search.FLOOR).otherwise(inverse[i]) * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * size / F.lit(mean)))
        total = lambda size: reduce(Column.__add__, [weigh(i, F.col(f"f{i}").cast("double"), size) for i in range(len(terms))], F.lit(0.0))
        per_term = lambda tf: [F.sum(F.when(F.col("term") == i, tf)).alias(f"f{i}") for i in range(len(terms))]
        whole = " and ".join(f"f{i} is not null" for i in range(len(terms)))
        bounds = heads.where("sign > 0").groupBy("_order", "block").agg(F.min("min_size").alias("size"), *per_term(F.col("max_tf") * F.col("occ"))).where(whole)
        bounds = bounds.select("_order", "block", (total(F.col("size")) * (1 + 1e-9)).alias("bound"))
        newer = self.log.live(at)[1:]
        changed = reduce(DataFrame.unionByName, [self.log.folder(x["docs"]).select("id", F.lit(x["order"]).alias("newest")) for x in newer]) if newer else None

        def best(some: DataFrame) -> DataFrame:
            rows = self._holding(terms, at).where("sign > 0").join(some, ["_order", "block"], "left_semi").select("_order", "block", "docs", F.inline(hits))
            rows = located(rows, "term", "occ").groupBy("_order", "block", "doc").agg(*per_term(F.col("tf") * F.col("occ"))).where(whole)
            found = rows.join(members(self.log.read(at)), ["_order", "block", "doc"])
            if changed is not None:
                found = found.join(changed.groupBy("id").agg(F.max("newest").alias("newest")), "id", "left").where("newest is null or newest <= _order")
            return wanted(found.select("id", (-total(F.col("size"))).alias("rank"))).orderBy("rank", "id").limit(k)

        front, first = bounds.orderBy(F.desc("bound"), "_order", "block").limit(WIDER * FIRST + 1).collect(), WIDER * FIRST
        out, more = scratch.save(best(self.spark.createDataFrame(front[:first], bounds.schema)), "best"), len(front) > first
        if more:
            least = out.agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
            rest = bounds.where(F.col("bound") >= -least["rank"]) if least["n"] == k else bounds
            more = least["n"] < k or front[first]["bound"] >= -least["rank"]
            if more:
                out = scratch.save(best(rest), "final")
        if told is not None:
            told.update(blocks=bounds.count(), read=rest.count() if more else len(front[:first]))
        scratch.keep("final" if more else "best")
        return out
