"""Minimum-cost-flow resharding."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, Scratch, read_table

SHARDS, OLD_SHARDS, OVERHEAD = 40, 32, 16
#: Rows of one file of a shard.
FILE_ROWS = 200_000


class Network:
    """A flow network with whole-number capacities and prices. Cheapest flows are found in phases: one search for the
    prices of all nodes, then all that flows at that price, by shortest paths of fewest arcs. Phases are as many as there
    are different prices of a path."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.left, self.price = [], [], []

    def arc(self, u: int, v: int, capacity: int, price: int) -> int:
        """Adds an arc; its flow is what is left on the arc after it, its reverse."""
        self.out[u].append(len(self.to))
        self.out[v].append(len(self.to) + 1)
        self.to += [v, u]
        self.left += [capacity, 0]
        self.price += [price, -price]
        return len(self.to) - 2

    def send(self, source: int, sink: int, need: int) -> None:
        high = [0] * len(self.out)
        while need:
            far = self._distances(source, high)
            if far[sink] is None:
                raise ValueError("the new shards are too small")
            high = [h + min(d if d is not None else far[sink], far[sink]) for h, d in zip(high, far, strict=True)]
            while need and (level := self._levels(source, sink, high)):
                need = self._fill(source, sink, need, high, level)

    def _distances(self, source: int, high: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.out)
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if far[u] is not None:
                continue
            far[u] = d
            for e in self.out[u]:
                if self.left[e] and far[v := self.to[e]] is None:
                    heapq.heappush(heap, (d + self.price[e] + high[u] - high[v], v))
        return far

    def _levels(self, source: int, sink: int, high: list[int]) -> dict[int, int]:
        """Arcs from the source to each node over arcs of the present price; nothing if the sink isn't reached."""
        level, front = {source: 0}, [source]
        while front and sink not in level:
            after = []
            for u in front:
                for e in self.out[u]:
                    v = self.to[e]
                    if self.left[e] and v not in level and self.price[e] + high[u] == high[v]:
                        level[v] = level[u] + 1
                        after.append(v)
            front = after
        return level if sink in level else {}

    def _fill(self, source: int, sink: int, need: int, high: list[int], level: dict[int, int]) -> int:
        at, path, u = dict.fromkeys(level, 0), [], source
        while need:
            if u == sink:
                most = min(need, *(self.left[e] for e in path))
                for e in path:
                    self.left[e] -= most
                    self.left[e ^ 1] += most
                need, path, u = need - most, [], source
            elif at[u] < len(self.out[u]):
                e = self.out[u][at[u]]
                v = self.to[e]
                if self.left[e] and level.get(v) == level[u] + 1 and self.price[e] + high[u] == high[v]:
                    path.append(e)
                    u = v
                else:
                    at[u] += 1
            elif path:
                u = self.to[path.pop() ^ 1]
                at[u] += 1
            else:
                break
        return need


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (old, new) -> bytes of least total cost that empties all supplies. ``cost(i, j)`` is the price of a byte of
    old shard i in new shard j, a whole number, not negative."""
    n, m, net = len(supply), len(capacity), Network(len(supply) + len(capacity) + 2)
    for i, x in enumerate(supply):
        net.arc(n + m, i, x, 0)
    for j, x in enumerate(capacity):
        net.arc(n + j, n + m + 1, x, 0)
    arcs = {(i, j): net.arc(i, n + j, supply[i], cost(i, j)) for i in range(n) for j in range(m)}
    net.send(n + m, n + m + 1, sum(supply))
    return {k: net.left[e + 1] for k, e in arcs.items() if net.left[e + 1]}


def least_moves(sizes: dict[int, int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Flow (old name, new) -> bytes, where a byte that stays in the shard of its name costs nothing and any other move
    costs one. As all moves cost the same, they pass one hub, so there are as many arcs as shards and not as pairs."""
    old, m = sorted(sizes), len(capacity)
    n = len(old)
    source, sink, hub, net = n + m, n + m + 1, n + m + 2, Network(n + m + 3)
    for i, name in enumerate(old):
        net.arc(source, i, sizes[name], 0)
    stay = {name: net.arc(i, n + name, sizes[name], 0) for i, name in enumerate(old) if 0 <= name < m}
    leave = [net.arc(i, hub, sizes[name], 1) for i, name in enumerate(old)]
    enter = [net.arc(hub, n + j, x, 0) for j, x in enumerate(capacity)]
    for j, x in enumerate(capacity):
        net.arc(n + j, sink, x, 0)
    net.send(source, sink, sum(sizes.values()))
    out = {(name, name): net.left[e + 1] for name, e in stay.items() if net.left[e + 1]}
    free, j = [net.left[e + 1] for e in enter], 0
    for name, e in zip(old, leave, strict=True):
        rest = net.left[e + 1]
        while rest:
            if not free[j]:
                j += 1
                continue
            part = min(rest, free[j])
            out[name, j] = out.get((name, j), 0) + part
            rest, free[j] = rest - part, free[j] - part
    return out


def plan_transfers(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old, from, to, new): which bytes of each old shard, counted in its own order, each new shard gets. New capacities
    are equal to one byte. Bytes that stay come first."""
    total = sum(sizes.values())
    flow = least_moves(sizes, [total // shards + (j < total % shards) for j in range(shards)])
    out, at = [], dict.fromkeys(sizes, 0)
    for (name, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((name, at[name], at[name] + n, j))
        at[name] += n
    return out


def reshard(docs: DataFrame, old_shard, shards: int = SHARDS, key: str | None = None) -> DataFrame:
    """doc_id, old_shard, size, text_crc32, shard, slot. A document goes where the plan sends its middle byte; order
    inside an old shard is by block, then doc_id. Null text counts as empty, null old shards as -1 (no new shard's
    own); repeated rows each get a slot, in any order among themselves; an empty table gives no rows. A third of all
    rows in one old shard, or of one doc_id or none, is spread over blocks by id, text and place in the input: no window
    holds a whole shard. One number for each shard comes to the driver. ``key`` names a column that tells rows apart; it
    is carried along."""
    mine = [key] if key else []
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(*mine, "doc_id", F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.monotonically_increasing_id() % SALTS)
    rows = Scratch(docs.sparkSession).save(rows.withColumn("__lone", lone), "sizes")
    found = rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    blocks = max([1, *(math.isqrt(r["n"]) for r in found)])
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text_crc32", "__lone"), F.lit(blocks))).drop("__lone")
    transfers = plan_transfers({r["old_shard"]: r["size"] for r in found}, shards) if found else []
    sums = rows.groupBy("old_shard", "__block").agg(F.sum("size").alias("__bytes"))
    starts = sums.select("old_shard", "__block", (F.sum("__bytes").over(Window.partitionBy("old_shard").orderBy("__block")) - F.col("__bytes")).alias("__start"))
    order = Window.partitionBy("old_shard", "__block").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("__inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(starts, ["old_shard", "__block"])
    at = F.col("__start") + F.col("__inside") + F.floor(F.col("size") / 2)
    ranges = docs.sparkSession.createDataFrame(transfers, "__old int, __from long, __to long, shard int")
    sent = rows.withColumn("__at", at).join(F.broadcast(ranges), (F.col("old_shard") == F.col("__old")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to")))
    group = ["shard", "old_shard", "__block"]
    base = sent.groupBy(*group).count().select(*group, (F.sum("count").over(Window.partitionBy("shard").orderBy("old_shard", "__block")) - F.col("count")).alias("__base"))
    slot = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "text_crc32", "size")) - 1
    return sent.withColumn("__slot", slot).join(base, group).select(*mine, "doc_id", "old_shard", "size", "text_crc32", "shard", (F.col("__base") + F.col("__slot")).cast("long").alias("slot"))


def rewrite_affected(docs: DataFrame, old_shard, path: str, shards: int = SHARDS, rows_per_file: int = FILE_ROWS) -> list[int]:
    """Reshards documents and writes the new files of every shard that gains or loses rows under ``path``/shard=N, in
    order of slot; other shards' files stay as they are, and folders of shards that lose all rows are deleted afterwards.
    Gives the shards affected, a bounded list.

    Each row has a number of its own from the beginning, so that repeated doc_ids and rows without one are written once
    each. A shard is cut into files by ranges of slots, which are written by many tasks. Columns of ``docs`` that are
    called shard or slot are written as shard_ and slot_."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    numbered = docs.select(*[F.col(c).alias(f"{c}_" if c in ("shard", "slot") else c) for c in docs.columns], old_shard.alias("__old"))
    numbered = scratch.save(numbered.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed = scratch.save(reshard(numbered, F.col("__old"), shards, "__row").select("__row", "old_shard", "shard", "slot"), "placed")
    moved = placed.where("old_shard != shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = sorted(r[0] for r in moved.collect())
    goes = placed.where(F.col("shard").isin(affected)).select("__row", "shard", "slot")
    rows = numbered.drop("__old").join(goes, "__row").drop("__row").withColumn("__file", F.floor(F.col("slot") / rows_per_file))
    rows = rows.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    held = {r[0] for r in placed.select("shard").distinct().collect()}
    for shard in affected:
        if shard not in held:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    scratch.keep()
    return affected


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps the rows of a source together, so that one old shard is far too large."""
    docs = read_table(spark, sf_dir, "documents")
    placed = reshard(docs, F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(OLD_SHARDS)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
