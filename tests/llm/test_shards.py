"""Resharding: least bytes moved, shards near equal, slots without gaps."""

import itertools
import random
import zlib

from pyspark.sql import functions as F

from stacklore.llm import resharding


def test_flow_is_least():
    rng = random.Random(8)
    for _ in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        capacity = [rng.randint(0, 4) for _ in range(m)]
        if sum(capacity) < sum(supply):
            continue
        price = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j, p=price: p[i][j])
        assert all(sum(v for (a, _), v in flow.items() if a == i) == supply[i] for i in range(n))
        assert all(sum(v for (_, b), v in flow.items() if b == j) <= capacity[j] for j in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]
        best = min((sum(price[i][j] for i, j in zip(units, to, strict=True)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(m))), default=0)
        assert sum(price[i][j] * v for (i, j), v in flow.items()) == best


def test_transfers_keep_what_can_stay():
    sizes = {0: 1000, 1: 10, 2: 40}
    moves = resharding.plan_transfers(sizes, 3)
    assert sum(b - a for o, a, b, n in moves if o == n) == 350 + 10 + 40


def test_thousands_of_shards_move_as_few_bytes_as_can_be():
    rng = random.Random(3)
    for old, new in ((3000, 2000), (7, 5000), (4000, 3), (5, 5)):
        sizes = {i: rng.randint(0, 10**6) for i in range(-1, old)}
        total = sum(sizes.values())
        capacity = [total // new + (j < total % new) for j in range(new)]
        moves = resharding.plan_transfers(sizes, new)
        assert sum(b - a for o, a, b, n in moves if o == n) == sum(min(n, capacity[i]) for i, n in sizes.items() if 0 <= i < new)
        got = [0] * new
        for _, a, b, j in moves:
            got[j] += b - a
        assert got == capacity and len(moves) <= 2 * (old + new) + 2


def test_hub_equals_the_dense_network():
    rng = random.Random(4)
    for _ in range(100):
        sizes, new = {i: rng.randint(0, 30) for i in rng.sample(range(8), rng.randint(1, 6))}, rng.randint(1, 7)
        total, old = sum(sizes.values()), sorted(sizes)
        capacity = [total // new + (j < total % new) for j in range(new)]
        dense = resharding.min_cost_flow([sizes[i] for i in old], capacity, lambda i, j, old=old: int(old[i] != j))
        cost = sum(v for (i, j), v in dense.items() if old[i] != j)
        assert cost == sum(v for (i, j), v in resharding.least_moves(sizes, capacity).items() if i != j)


def placed(docs):
    return resharding.reshard(docs, F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(32)))


def test_tables(spark, documents, awkward, empty, tmp_path):
    for docs in (documents, awkward):
        rows = placed(docs).collect()
        expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == expected
        sizes, slots = {}, {}
        for r in rows:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == [*range(len(s))] for s in slots.values()) and all(0 <= s < 40 for s in slots)
        total, largest = sum(sizes.values()), max(r["size"] for r in rows)
        assert all(abs(sizes.get(s, 0) - total / 40) <= 2 * largest for s in range(40))
    assert placed(empty).count() == 0


def layout(_):
    return F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(32))


def key(r):
    return tuple(map(str, r))


def test_affected_files_hold_all_rows(spark, documents, awkward, tmp_path):
    """A fifth of the rows without doc_id, the others' ids repeated: each row is written once."""
    n = F.col("doc_id")
    docs = documents.withColumn("doc_id", F.when(n % 5 > 0, n % 7)).withColumn("slot", F.lit("own"))
    for name, rows in (("many", docs), ("odd", awkward)):
        path = str(tmp_path / name)
        old = rows.withColumnRenamed("slot", "slot_").withColumn("shard", layout(rows))
        old.write.partitionBy("shard").parquet(path)
        written = resharding.rewrite_affected(rows, layout(rows), path, rows_per_file=3)
        assert written
        back = spark.read.parquet(path)
        names = [f"{c}_" if c in ("shard", "slot") else c for c in rows.columns]
        assert sorted(map(key, back.select(*names).collect())) == sorted(map(key, rows.collect()))
        sizes = [r["n"] for r in back.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("n")).collect()]
        largest = max(len((r["text"] or "").encode()) + 16 for r in rows.collect())
        assert max(sizes) <= sum(sizes) / 40 + 2 * largest


def test_emptied_shards_leave_no_files(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    documents.withColumn("shard", layout(documents)).write.partitionBy("shard").parquet(path)
    resharding.rewrite_affected(documents, layout(documents), path, shards=3)
    back = spark.read.parquet(path)
    assert {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2} and back.count() == documents.count()
    slots = {}
    for r in back.select("shard", "slot").collect():
        slots.setdefault(r[0], []).append(r[1])
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
