"""Merkle manifest of a dataset: trees of fan-out 8 per group, with authentication paths by fractal traversal."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

FAN = 8
#: Levels of one stacked subtree, and stacked subtrees of one block: a task holds blocks of FAN ** (BAND * BANDS) leaves.
BAND, BANDS = 2, 2
BLOCK = FAN ** (BAND * BANDS)
PATH = "array<struct<left:string,right:string>>"


def digest_of(*columns: Column) -> Column:
    """The leaf of a row: lengths keep values apart, nulls differ from all values."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, columns)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def height(n: int) -> int:
    """Levels above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


class Hashing:
    """A tree that grows leaf by leaf. Of each level only the open run is held, and of the levels low to high - 1 all
    nodes, those of one stacked subtree."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high
        self.open: list[list[str]] = [[] for _ in range(high + 1)]
        self.kept: list[list[str]] = [[] for _ in range(high - low)]

    def feed(self, node: str) -> None:
        level = 0
        while True:
            if self.low <= level < self.high:
                self.kept[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if level == self.high or len(run) < FAN:
                return
            node, level = sha256("".join(run).encode()).hexdigest(), level + 1
            run.clear()

    def close(self) -> None:
        """Ends the runs that the last leaves left short."""
        for level in range(self.high):
            if run := self.open[level]:
                node = sha256("".join(run).encode()).hexdigest()
                run.clear()
                if self.low <= level + 1 < self.high:
                    self.kept[level + 1 - self.low].append(node)
                self.open[level + 1].append(node)


def block_root(leaves: list[str], levels: int) -> str:
    tree = Hashing(levels, levels)
    for leaf in leaves:
        tree.feed(leaf)
    tree.close()
    return tree.open[levels][0]


def traverse(leaves: list[str], levels: int, band: int = BAND) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf within a block of ``levels`` levels, in order. For each band of levels the existing subtree
    over the present leaf is held, and the desired one, the next at that height, grows by one leaf with each path that is
    given; when the leaves of the existing subtree are through, the desired one takes its place. So what is held is two
    subtrees of each band and one open run of each level, whatever the block's size."""
    bands = [(low, min(low + band, levels)) for low in range(0, levels, band)]
    existing, desired, eaten = [], [], []
    for low, high in bands:
        first = Hashing(low, high)
        at = min(FAN**high, len(leaves))
        for leaf in leaves[:at]:
            first.feed(leaf)
        first.close()
        existing.append(first)
        desired.append(Hashing(low, high))
        eaten.append(at)
    for i in range(len(leaves)):
        path = []
        for (low, high), tree in zip(bands, existing, strict=True):
            for level in range(low, high):
                at = i // FAN**level - i // FAN**high * FAN ** (high - level)  # place in the kept level of the subtree
                run = at // FAN * FAN
                nodes = tree.kept[level - low]
                path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])))
        yield path
        for k, (low, high) in enumerate(bands):
            if eaten[k] < len(leaves):
                desired[k].feed(leaves[eaten[k]])
                eaten[k] += 1
            if (i + 1) % FAN**high == 0:
                desired[k].close()
                existing[k], desired[k] = desired[k], Hashing(low, high)


def ranked(rows: DataFrame, trees: list[str], order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``pos``, the place from 0 of each row in its tree, and ``n``, the number of the tree's rows. Rows are sorted by
    ranges, so a tree with most rows is sorted by many tasks; equal rows take any of their places."""
    spread = [*trees, *order, "lone"]
    part = scratch.save(rows.withColumn("lone", F.monotonically_increasing_id()), f"{name}_rows")
    part = scratch.save(part.repartitionByRange(*spread).withColumn("part", F.spark_partition_id()), f"{name}_sorted")
    sums = part.groupBy(*trees, "part").count()
    up = Window.partitionBy(*trees).orderBy("part")
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in (*trees, "part")], (F.sum("count").over(up) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy(*trees)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*trees, "part").orderBy(*order, "lone")) - 1
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*trees, "part")]
    done = part.withColumn("inside", inside).join(sums, same).withColumn("pos", F.col("before") + F.col("inside"))
    done = scratch.save(done.select(*rows.columns, "pos", "n"), name)
    scratch.drop(f"{name}_rows", f"{name}_sorted")
    return done


def climb(nodes: DataFrame, scratch: Scratch, name: str, block: int = BLOCK) -> list[DataFrame]:
    """The levels of all trees (tree, pos, n, digest, ...): the given nodes, then the roots of their aligned blocks, and so
    on until each tree has one node. Rounds are as many as the number of nodes has digits to the base ``block``."""
    levels = [nodes]
    while levels[-1].where("n > 1").limit(1).count():

        def roots(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            n, tree, pos = (table.column(c)[0].as_py() for c in ("n", "tree", "pos"))
            root = block_root(table.column("digest").to_pylist(), min(height(n), height(block)))
            return pa.table({"tree": pa.array([tree], pa.int64()), "pos": pa.array([pos // block], pa.int64()), "n": pa.array([-(-n // block)], pa.int64()), "digest": [root]})

        grouped = levels[-1].select("tree", "pos", "n", "digest", F.floor(F.col("pos") / block).alias("block")).groupBy("tree", "block")
        levels.append(scratch.save(grouped.applyInArrow(roots, "tree long, pos long, n long, digest string"), f"{name}{len(levels)}"))
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str, keep: str = "", block: int = BLOCK) -> DataFrame:
    """Paths of the nodes of the lowest level. ``tops`` (tree, root, subroot, path) tells of each tree's own root; in each
    round a block's nodes meet their block's row, whose path is appended to what the traversal of the block gives."""
    upper = tops.withColumn("pos", F.lit(0).cast("long"))
    for depth in range(len(levels) - 2, -1, -1):
        more = keep if depth == 0 else ""
        carried = [x.split()[0] for x in more.split(",")] if more else []
        lower = levels[depth].select("tree", "pos", "n", "digest", *carried, F.floor(F.col("pos") / block).alias("block"))
        upper = upper.withColumnRenamed("pos", "block").select("tree", "block", "root", "subroot", "path")
        kind = ", ".join(["tree long, pos long, digest string", *([more] if more else []), f"root string, subroot string, path {PATH}"])
        upper = lower.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(_appending(carried, block), kind)
        if depth:
            upper = scratch.save(upper, f"{name}_paths{depth}")
    return upper


def _appending(carried: list[str], block: int):
    """The function that traverses one block and appends the path of its root."""
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def paths(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        n, leaves = left.column("n")[0].as_py(), left.column("digest").to_pylist()
        above = right.column("path")[0].as_py()
        found = [[*({"left": a, "right": b} for a, b in path), *above] for path in traverse(leaves, min(height(n), height(block)))]
        same = lambda c: pa.array([right.column(c)[0].as_py()] * len(leaves), pa.string())
        columns = {c: left.column(c) for c in ("tree", "pos", "digest", *carried)}
        return pa.table(columns | {"root": same("root"), "subroot": same("subroot"), "path": pa.array(found, step)})

    return paths


def merkle_manifest(rows: DataFrame, group: str, order: str, leaf: Column, extra: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row: ``order``, leaf, the strings of ``extra``, subroot (of the tree of its group), root (of the tree of
    all subroots) and path, an array from the leaf up to the root of what stands left and right of the node in its run.

    Leaves of a group ascend by ``order``, nulls first, and groups by their bytes, null first; what compares equal takes any
    of its places. Repeated rows are leaves each; an empty table gives no rows; other columns are read only where ``leaf``
    and ``extra`` name them, and names may clash with the result's. Texts are hashed where they are scanned and never
    shuffled. A task holds one aligned block of ``block`` nodes, a power of FAN, so that neither a large group nor a path
    makes it grow; blocks meet their upper paths, not leaves."""
    scratch, extra = Scratch(rows.sparkSession), extra or {}
    leaves = rows.select(F.col(group).alias("grp"), F.col(order).cast("long").alias("key"), leaf.alias("digest"), *[c.cast("string").alias(k) for k, c in extra.items()])
    leaves = ranked(leaves, ["grp"], ["key", "digest"], scratch, "leaves")
    groups = scratch.save(leaves.where("pos = 0").select("grp", F.col("n").alias("size")), "groups")
    groups = ranked(groups.withColumn("all", F.lit(0)), ["all"], ["grp"], scratch, "trees").select(F.col("grp").alias("__grp"), F.col("pos").alias("tree"), F.col("n").alias("trees"))
    few = groups.count() <= 10_000
    leaves = scratch.save(leaves.join(F.broadcast(groups) if few else groups, F.col("grp").eqNullSafe(F.col("__grp"))).drop("grp", "__grp", "trees"), "nodes")
    levels = climb(leaves, scratch, "blocks", block)
    subroots = scratch.save(levels[-1].select(F.lit(0).cast("long").alias("all"), F.col("tree").alias("pos"), F.col("digest").alias("subroot")).join(groups.select(F.col("tree").alias("pos"), F.col("trees").alias("n")), "pos"), "subroots")
    above = climb(subroots.select(F.col("all").alias("tree"), "pos", "n", F.col("subroot").alias("digest")), scratch, "roots", block)
    none = F.array().cast(PATH)
    tops = above[-1].select("tree", F.col("digest").alias("root"), F.lit("").alias("subroot"), none.alias("path"))
    known = descend(above, tops, scratch, "roots", block=block) if len(above) > 1 else above[0].select("tree", "pos", "digest", F.col("digest").alias("root"), none.alias("path"))
    tops = scratch.save(known.select(F.col("pos").alias("tree"), "root", F.col("digest").alias("subroot"), "path"), "tops")
    keep = ", ".join(["key long", *[f"{k} string" for k in extra]])
    if len(levels) > 1:
        done = descend(levels, tops, scratch, "blocks", keep, block)
    else:
        done = levels[0].join(tops, "tree")
    return done.select(F.col("key").alias(order), F.col("digest").alias("leaf"), *extra, "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in trees per language. Where 3 divides the checksum of doc_id, the proof is asked to accept a text in lower
    case; a null doc_id has no checksum and isn't tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, digest_of(*columns, lower))
    done = merkle_manifest(docs, "lang", "doc_id", digest_of(*columns, F.col("text")), {"tampered": tampered})
    shown = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    done = done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), shown.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels by recursion, paths by joining each level's runs, checksums bit by bit.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_concat([ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS bad FROM d),
k AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n(tree, lvl, idx, digest, n) AS (SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM k
  UNION ALL SELECT tree, lvl, idx, digest, count(*) OVER (PARTITION BY tree) FROM (SELECT tree, lvl + 1 AS lvl, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM n WHERE n > 1 GROUP BY tree, lvl, idx // 8)),
s AS (SELECT tree, digest AS subroot, lvl AS top FROM n WHERE n = 1),
m(lvl, idx, digest, n) AS (SELECT 0, tree - 1, subroot, count(*) OVER () FROM s
  UNION ALL SELECT lvl, idx, digest, count(*) OVER () FROM (SELECT lvl + 1 AS lvl, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM m WHERE n > 1 GROUP BY lvl, idx // 8)),
e AS (SELECT k.tree, k.pos, n.lvl, k.pos // (8 ** n.lvl)::BIGINT AS own, n.idx, n.digest FROM k JOIN n ON n.tree = k.tree AND n.n > 1 AND n.idx // 8 = (k.pos // (8 ** n.lvl)::BIGINT) // 8
  UNION ALL SELECT k.tree, k.pos, s.top + m.lvl, (k.tree - 1) // (8 ** m.lvl)::BIGINT, m.idx, m.digest FROM k JOIN s USING (tree) JOIN m ON m.n > 1 AND m.idx // 8 = ((k.tree - 1) // (8 ** m.lvl)::BIGINT) // 8),
p AS (SELECT tree, pos, lvl, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS a, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS b FROM e GROUP BY tree, pos, lvl),
w AS (SELECT tree, pos, sha256(string_agg(a || b, '' ORDER BY lvl)) AS proof, count(*) AS steps FROM p GROUP BY tree, pos),
f(tree, pos, lvl, node) AS (SELECT tree, pos, 0, coalesce(bad, leaf) FROM k UNION ALL SELECT f.tree, f.pos, f.lvl + 1, sha256(p.a || f.node || p.b) FROM f JOIN p USING (tree, pos, lvl)),
r AS (SELECT digest AS root FROM m WHERE n = 1)
SELECT k.doc_id, k.leaf, s.subroot, r.root, coalesce(w.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM k JOIN s USING (tree) CROSS JOIN r LEFT JOIN w USING (tree, pos) JOIN f ON f.tree = k.tree AND f.pos = k.pos AND f.lvl = coalesce(w.steps, 0)
"""
