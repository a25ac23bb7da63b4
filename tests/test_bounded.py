"""Operators whose rounds or groups are bounded: closures, chains, budgets, counts that follow the log."""

import random

import pytest
from pyspark.sql import functions as F

from stacklore.errors import Validation
from stacklore.library import Library
from stacklore.operators import export, graph, identity, stats, topics

TOPIC = "id string, parent_topic_id string"


def closure(parents):
    out = set()
    for t in parents:
        at, d = t, 0
        while at is not None:
            out.add((t, at, d))
            at, d = parents.get(at), d + 1
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_deep_trees_and_cycles(spark):
    deep = {f"t{i}": f"t{i - 1}" if i else None for i in range(1000)}
    got = topics.ancestors(spark.createDataFrame(list(deep.items()), TOPIC))
    assert got.count() == 1000 * 1001 // 2 and got.agg(F.max("distance")).first()[0] == 999
    rng = random.Random(1)
    wide = {f"t{i}": f"t{rng.randrange(i)}" if i and rng.random() < 0.9 else None for i in range(60)} | {"orphan": "nobody"}
    assert rows(topics.ancestors(spark.createDataFrame(list(wide.items()), TOPIC))) == closure(wide)
    with pytest.raises(Validation):
        topics.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", None)], TOPIC))
    with pytest.raises(Validation):
        topics.ancestors(spark.createDataFrame([("a", "a")], TOPIC))


def test_moved_topics(spark):
    parents = {"r": None, "s": None, "a": "r", "b": "a", "c": "b", "d": "a", "e": "s"}
    before = topics.ancestors(spark.createDataFrame(list(parents.items()), TOPIC))
    for changes in ({"b": "e"}, {"a": None}, {"b": "r", "e": "d"}, {"s": "c"}):
        after = topics.moved(before, spark.createDataFrame(list(changes.items()), "topic string, parent string"))
        assert rows(after) == closure(parents | changes)
    with pytest.raises(Validation):
        topics.moved(before, spark.createDataFrame([("a", "c")], "topic string, parent string"))


@pytest.mark.parametrize("parts", [1, 3, 512])
def test_budget_over_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(topics, "PARTS", parts)
    rng = random.Random(parts)
    data = [(f"t{rng.choice([0, 0, 0, 1, 2])}", f"p{i}", rng.randrange(40), rng.choice([0, 1, 2, 7, 30])) for i in range(900)]
    df = spark.createDataFrame(data, "topic string, paper string, score int, cost int")
    got = topics.within_budget(df, "topic", [F.desc("score"), F.asc("paper")], F.col("cost"), 100)
    expected = set()
    for t in ("t0", "t1", "t2"):
        used = 0
        for n, r in enumerate(sorted((r for r in data if r[0] == t), key=lambda r: (-r[2], r[1])), 1):
            if used <= 100:
                expected.add((t, r[1], used, n))
            used += r[3]
    assert rows(got.select("topic", "paper", "before", "position")) == expected


def test_bounded_briefs(spark):
    links = spark.createDataFrame([("t", f"p{i}", i % 7 / 10) for i in range(50)], "topic_id string, paper_id string, relevance double")
    papers = spark.createDataFrame([(f"p{i}", f"T{i}") for i in range(50)], "id string, title string")
    gaps = spark.createDataFrame([(f"g{i}", "d", "t", i / 50) for i in range(50)], "id string, description string, topic_id string, priority double")
    args = spark.createDataFrame([("t", "n"), ("u", "n")], "id string, name string"), spark.createDataFrame([], "topic_id string, x int"), papers, links, gaps
    whole = {r["topic_id"]: r for r in topics.briefs(*args).collect()}
    some = {r["topic_id"]: r for r in topics.briefs(*args, most=5).collect()}
    assert len(whole["t"]["papers"]) == 50 and some["u"]["papers"] == []
    assert some["t"]["papers"] == whole["t"]["papers"][:5] and some["t"]["gaps"] == whole["t"]["gaps"][:5]


def test_merged_tags_keep_the_order_of_papers(spark):
    papers = spark.createDataFrame([("a", "10.1/x", 1, "2024", ["old", " b", "b", ""]), ("c", "10.1/X", 2, "2025", ["new", "old"]), ("d", "10.1/y", 3, "2025", None)], "id string, doi string, seq int, created_at string, tags array<string>")
    items = spark.createDataFrame([("k", 1, "10.1/x", ["kept "]), ("m", 1, "10.1/y", ["z"])], "key string, version int, doi string, tags array<string>")
    got = {r["id"]: r for r in export.plan(papers, items).collect()}
    assert got["a"]["merged"] == got["c"]["merged"] == ["kept", "new", "old", "b"] and got["d"]["outcome"] == "unchanged"


def loop(batch):
    """Rows one by one: (id, doi, path) -> new or not."""
    taken, out = set(), {}
    for i, doi, path in batch:
        out[i] = not ({("d", doi), ("p", path)} & taken - {("d", None), ("p", None)})
        if out[i]:
            taken |= {("d", doi), ("p", path)}
    return out


@pytest.mark.parametrize("n", [40, 10_000])
def test_long_chains_of_keys(spark, n, monkeypatch):
    saved = []
    plain = identity.Scratch.save
    monkeypatch.setattr(identity.Scratch, "save", lambda self, df, name, *f: saved.append(name) or plain(self, df, name, *f))
    chain = [(f"r{i:05d}", f"10.1/{i // 2}", f"/p/{(i + 1) // 2}") for i in range(n)]  # each row shares a key with the one before
    library = spark.createDataFrame([], "id string, doi string, pdf_path string, title string, seq long")
    batch = spark.createDataFrame([(*r, None, i) for i, r in enumerate(chain)], library.schema)
    got = {r["id"]: r["is_new"] for r in identity.resolve_batch(batch, library).select("id", "is_new").collect()}
    assert got == loop(chain)
    assert sum(x.startswith("links") for x in saved) <= 16 and sum(x.startswith("open") for x in saved) <= 6


def test_branching_chains(spark):
    rng = random.Random(9)
    batch = [(f"r{i:03d}", f"10.1/{rng.randrange(40)}" if rng.random() < 0.8 else None, f"/p/{rng.randrange(40)}") for i in range(120)]
    library = spark.createDataFrame([], "id string, doi string, pdf_path string, title string, seq long")
    rows = spark.createDataFrame([(*r, None, i) for i, r in enumerate(batch)], library.schema)
    got = {r["id"]: r["is_new"] for r in identity.resolve_batch(rows, library).select("id", "is_new").collect()}
    assert got == loop(batch)


def test_counts_follow_the_log(spark, tmp_path, monkeypatch):
    library = Library(spark, str(tmp_path / "lib"))
    rng = random.Random(2)

    def same():
        counts, read = library.counts(), library.read
        assert rows(counts.overview()) == rows(stats.overview(read("topics"), read("papers"), read("gaps"), read("reports")))
        for column in ("status", "reading_status"):
            assert rows(counts.funnel(column)) == rows(stats.funnel(read("papers"), column))
        assert rows(counts.edges()) == rows(graph.label_counts(read("citations")))

    for step in range(5):
        papers = [(f"p{rng.randrange(9)}", "T", rng.choice(["read", "odd", "discovered"]), rng.choice(["queued", "completed"]), rng.choice([None, 3])) for _ in range(4)]
        library.upsert("papers", spark.createDataFrame(papers, "id string, title string, status string, reading_status string, rating int"))
        if step == 2:
            library.upsert("papers", library.read("papers").where("id < 'p4'"), deleted=True)
            library.compact("papers", 0)
        library.insert_citations(spark.createDataFrame([(f"p{step}", f"p{rng.randrange(3)}", rng.choice(["", "x"]), 1)], "citing string, cited string, context string, seq long"))
        if step != 1:
            same()
    read = []
    plain = Library.read
    monkeypatch.setattr(Library, "read", lambda self, table, at=None: read.append(table) or plain(self, table, at))
    library.upsert("papers", spark.createDataFrame([("new", "N")], "id string, title string"))
    library.counts()
    assert read == []  # the change alone was summed up
