"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide.

Each tree of the forest orders signatures by DEPTH MinHash values; a node of its prefix trie is named by the hash of a
prefix. Matching starts at the full depth and shortens prefixes until a pair at the threshold meets with the target
recall. At each depth every signature of a trie node meets one leader. Those that surely belong to the leader leave the
tree and it stands for them at shorter prefixes. What is left at the last depth is compared pair by pair, in blocks,
inside the tasks, which give only the links that join what they found. So no node gives more rows than it has members,
and no candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, keyed_join, read_table, slices, text_or_empty, texts_of
from .components import components
from .shingles import apart, shingles, signatures, similar_pairs

THRESHOLD, TREES, DEPTH, RECALL = 0.8, 16, 6, 0.999
#: Shares of equal signature values from which a pair is a candidate, and from which a member leaves for its leader. A
#: text similar to a member by the threshold is similar to the leader by twice the threshold less one at least.
CANDIDATE, SURE = 0.45, 0.8
#: Texts of one side of a verification task; ids which may be broadcast to fetch the texts of candidates.
BLOCK, MAX_IDS = 256, 500_000
#: Signatures of one side of a comparison task.
SIGNATURE_BLOCK = 512


def least_depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which a pair of that similarity meets in one of the trees with that probability."""
    fits = [r for r in range(1, 64) if 1 - (1 - threshold**r) ** trees >= recall]
    return max(fits, default=1)


def signed(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, key (digest of the text; null for null texts), signature (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 19):
            sets = shingles(texts_of(batch.column(2)))
            values = signatures(sets, trees * depth).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() if len(s) else None for v, s in zip(values, sets, strict=True)], pa.binary())], ["doc_id", "key", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(F.col("text").cast("string"), "UTF-8"))).alias("key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, signature binary")


def forest(nodes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """nid, h, and for each tree the names k<d> of its trie nodes at the depths d."""
    values = lambda t, d: F.substring(F.col("signature"), t * (4 * depth) + 1, F.lit(4 * d))
    rows = nodes.where("signature is not null and first_id is not null").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return rows.select("nid", F.xxhash64("first_id", "key").alias("h"), *[F.xxhash64("t", values(F.col("t"), d)).alias(f"k{d}") for d in range(least, depth + 1)])


def _agreement(pairs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Adds est: the share of equal values in the signatures of a and b."""
    one = nodes.select(F.col("nid").alias("a"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("nid").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, count) for c in batch.columns[2:4])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(1) if len(x) else [], pa.float64())], ["a", "b", "est"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, est double")


def tasks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of equal first ``keys`` columns, over the ends of batches, with the other columns as rows."""
    task, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != task:
                if rows:
                    yield task, rows
                task, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield task, rows
    del rows
    give_back()


def walk(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join all that a symmetric boolean matrix joins."""
    seen = np.zeros(len(linked), bool)
    for k in range(len(linked)):
        front = [] if seen[k] else [k]
        seen[k] = True
        while front:
            x = front.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            for y in new.tolist():
                yield x, y
                front.append(y)


def in_blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """For rows (nid, ...) with n, the size of their group: i, j, block; every pair of blocks of a group is one task."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("nid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "n")


def compared(live: DataFrame, sizes: DataFrame, key: str, nodes: DataFrame, count: int) -> DataFrame:
    """Links (a, b) that join all pairs of a trie node whose signatures agree in a share of CANDIDATE or more."""
    dealt = in_blocks(live.select(key, "nid").join(sizes.select(key, "n"), key), key, SIGNATURE_BLOCK).join(nodes.select("nid", "signature"), "nid")
    dealt = dealt.select(key, "i", "j", "block", "nid", "signature").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, i, j), rows in tasks(batches, 3):
            values = np.frombuffer(b"".join(r[2] for r in rows), "<u4").reshape(-1, count)
            block = np.array([r[0] for r in rows])
            linked = np.zeros((len(rows), len(rows)), bool)
            for k in range(len(rows)):
                linked[k] = (values == values[k]).sum(1) >= CANDIDATE * count
            if i != j:
                linked &= block[:, None] != block[None, :]
            out += [(rows[x][1], rows[y][1]) for x, y in walk(linked) if x != y]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["a", "b"])
                out = []
            del rows, values, linked
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, scratch: Scratch, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """Links (a, b) that hold every pair at the threshold inside one component, with the recall of the forest."""
    least = least_depth(threshold, trees, recall)
    all_rows = forest(nodes, trees, depth, least)
    shared = all_rows.groupBy(f"k{least}").count().where("count > 1").select(f"k{least}")
    live = scratch.save(all_rows.join(shared, f"k{least}", "left_semi"), "forest")
    out = None
    for d in range(depth, least - 1, -1):
        key = f"k{d}"
        names = [f"k{x}" for x in range(least, d + 1)]
        sizes = live.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("h", "nid")).alias("first")).where("n > 1")
        sizes = scratch.save(sizes.select(key, "n", F.col("first.nid").alias("leader")), f"leaders{d}")
        met = live.join(sizes, key).where("nid != leader").select(F.col("leader").alias("a"), F.col("nid").alias("b")).distinct()
        judged = scratch.save(_agreement(met, nodes, trees * depth).where(F.col("est") >= CANDIDATE), f"judged{d}")
        out = judged.select("a", "b") if out is None else out.unionByName(judged.select("a", "b"))
        # who surely belongs to its leader leaves this tree; at the last depth the leader, having met all, leaves too
        sure = judged.where(F.col("est") >= SURE).select(F.col("a").alias("leader"), F.col("b").alias("nid"), F.lit(True).alias("sure"))
        led = live.join(sizes.select(key, "leader"), key, "left").join(sure, ["leader", "nid"], "left")
        stay = F.col("sure").isNull()
        if d == least:
            stay &= F.col("leader").isNotNull() & (F.col("nid") != F.col("leader"))
        live = scratch.save(led.where(stay).select("nid", "h", *names), f"live{d}")
    key = f"k{least}"
    sizes = live.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return out.unionByName(compared(live, sizes, key, nodes, trees * depth))


def shingled(docs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Shingle sets of the texts of candidate components, made once: root, n (texts of the component), nid, size, kept,
    base, shingles. In a component of more than BLOCK texts a set is what it has apart from that of the component's
    leader, the least nid, whose size is ``base``; copies of one text differ in few shingles from each other."""
    counts = members.groupBy("root").agg(F.count("*").alias("n"), F.min("nid").alias("leader")).where("n > 1")
    chosen = members.join(counts, "root").select("nid", "root", "key", F.col("first_id").alias("doc_id"), "n", "leader")
    chosen = scratch.save(chosen, "chosen")
    total = chosen.count()
    if total <= MAX_IDS:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(F.col("text").cast("string"), "UTF-8"))).alias("key"), F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, ["doc_id", "key"]).select("root", "n", "leader", "nid", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4, 1 << 19):
            sets = shingles(texts_of(batch.column(4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["root", "n", "leader", "nid", "size", "shingles"])

    sets = scratch.save(rows.mapInArrow(make, "root long, n long, leader long, nid long, size long, shingles binary"), "sets")
    if sets.count() > total:  # repeated rows of one id and text are one member
        sets = scratch.save(sets.dropDuplicates(["nid"]), "sets-once")
    small = sets.where(F.col("n") <= BLOCK).select("root", "n", "nid", "size", F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("base"), "shingles")
    large = sets.where(F.col("n") > BLOCK)
    leaders = scratch.save(large.where("nid = leader").select("root", F.col("shingles").alias("theirs")), "sets-leaders")
    # one row for each component of more than BLOCK texts
    beside = keyed_join(large.select("nid", "root", "n", "size", "shingles"), leaders, ["root"]).select("root", "n", "nid", "size", "shingles", "theirs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, base = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (4, 5))
            found = [apart(x, y) for x, y in zip(own, base, strict=True)]
            out = [pa.array([k for _, k in found], pa.int64()), pa.array([len(y) for y in base], pa.int64()), pa.array([x.tobytes() for x, _ in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *out], ["root", "n", "nid", "size", "kept", "base", "shingles"])

    return small.unionByName(beside.mapInArrow(cut, "root long, n long, nid long, size long, kept long, base long, shingles binary"))


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """From the sets of candidate components: for each text its number n of similar texts in one task (other null), and
    links (nid, other) that join all similar texts.

    A component of more than BLOCK texts is cut into blocks, and every pair of blocks is one task, which gets sets that
    are cut to what differs; a pair counts if its exact Jaccard similarity reaches the threshold."""
    dealt = in_blocks(sets, "root", BLOCK).select("root", "i", "j", "block", "nid", "size", "kept", "base", "shingles")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["nid", "other", "n"])

        out = []
        for (_, i, j), rows in tasks(batches, 3):
            blocks, nids, sizes, kept = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            linked = similar_pairs([np.frombuffer(r[5], np.uint64) for r in rows], threshold, sizes, kept, rows[0][4])
            if i != j:
                linked &= blocks[:, None] != blocks[None, :]
            nids = nids.tolist()
            out += [(nids[k], None, int(linked[k].sum())) for k in np.flatnonzero(linked.any(1))]
            out += [(nids[x], nids[y], 0) for x, y in walk(linked)]
            if len(out) > 5000:
                yield flushed(out)
                out = []
            del rows, linked
        yield flushed(out)

    return dealt.mapInArrow(run, "nid long, other long, n long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, keys: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each row of ``docs``.

    Texts are sets of five-word shingles. Rows of equal text, and of texts joined by links of a Jaccard similarity of
    ``threshold`` or more, share class_id, the least doc_id among them. n_links counts the other distinct texts that a
    text is similar to, n_copies the rows of its very text. Fewer than five words make one shingle; empty texts are
    copies of each other and have no links; a null text is its row's own class. Rows of null doc_id take the class of
    their equal texts; a text all of whose rows have null ids is linked to nothing, class null. Repeated rows count as
    copies; an empty table gives no rows; other columns are not read.

    Two classes have one class_id where one doc_id has two texts. ``keys`` adds what tells them apart: key (digest of the
    text), first_id (the least doc_id of the text) and class_key (the key of the text that class_id belongs to)."""
    scratch = Scratch(docs.sparkSession)
    depth = max(depth, least_depth(threshold, trees, recall))
    rows = scratch.save(signed(docs, trees, depth), "signed")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("signature").alias("signature"))
    nodes = scratch.save(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    links = candidates(nodes, scratch, threshold, trees, depth, recall)
    members = components(links, scratch, "candidate").withColumnRenamed("node", "nid").join(nodes.select("nid", "key", "first_id"), "nid")
    sets = scratch.save(shingled(docs, scratch.save(members, "members"), scratch), "deltas")
    found = scratch.save(verified(sets, threshold), "verified")
    numbers = found.where("other is null").groupBy("nid").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("other is not null").select(F.col("nid").alias("a"), F.col("other").alias("b")), scratch, "class").withColumnRenamed("node", "nid")
    classed = nodes.select("nid", "key", "first_id", "n_copies").join(roots, "nid", "left").join(numbers, "nid", "left")
    least = classed.where("root is not null").groupBy("root").agg(F.min(F.struct("first_id", "key")).alias("least"))
    more = ["first_id", F.coalesce("least.key", "key").alias("class_key")] if keys else []
    classed = classed.join(least, "root", "left").select("key", F.coalesce("least.first_id", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies", *more)
    classed = scratch.save(classed, "classes")
    scratch.keep("signed", "classes")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    more = ["key", F.col("doc_id").alias("first_id"), F.col("key").alias("class_key")] if keys else []
    own = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), one.alias("n_copies"), *more)
    more = ["key", "first_id", "class_key"] if keys else []
    return rows.where("key is not null").select("doc_id", "key").join(classed, "key").select("doc_id", "class_id", "n_links", "n_copies", *more).unionByName(own)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
