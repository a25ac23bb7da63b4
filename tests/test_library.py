"""The library on disk: upserts, migrations, edges, errors, streaming import."""

import json
import random
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacklore import postings
from stacklore.commits import CommitLog, Conflict
from stacklore.errors import NotFound, Validation
from stacklore.library import Library
from stacklore.operators import search
from stacklore.schema import PAPERS
from stacklore.streaming import imports


@pytest.fixture
def library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    rows = [{"id": f"p{i}", "title": f"Quantum paper {i}", "tags": ["t"], "doi": f"10.1/{i}", "keywords": "", "created_at": "2024", "relevance_score": 0.5} for i in range(4)]
    lib.upsert("papers", spark.createDataFrame([{**dict.fromkeys(PAPERS.names), **r} for r in rows], PAPERS))
    return lib


def paper(lib, key):
    return lib.get_paper(key).first()


def test_changes(library):
    library.set_body("p1", "a body")
    library.set_status("p1", "read")
    library.set_rating("p1", 4)
    library.set_keywords("p1", "k" * 600)
    row = paper(library, "p1")
    assert (row["status"], row["rating"], len(row["keywords"]), row["title"]) == ("read", 4, 512, "Quantum paper 1")
    library.set_rating("p1", None)
    assert paper(library, "p1")["rating"] is None
    assert library.read("bodies").count() == 1  # a renewed paper keeps its body
    library.set_pdf_path("nobody", "/x")
    with pytest.raises(NotFound):
        library.set_status("nobody", "read")
    with pytest.raises(Validation):
        library.set_rating("p1", 257)
    library.compact("papers")
    assert library.read("papers").count() == 4 and paper(library, "p1")["status"] == "read"


def test_older_tables_get_defaults(spark, library):
    library.upsert("papers", spark.createDataFrame([("old", "An old one")], "id string, title string"))
    row = paper(library, "old")
    assert (row["reading_status"], row["keywords"], row["relevance_score"]) == ("unread", "", 0.5)


def test_edges(spark, library):
    edges = spark.createDataFrame([("p1", "p2", "", 1), ("p1", "p2", "late", 2), ("p1", "p3", "", 3)], "citing string, cited string, context string, seq long")
    assert library.insert_citations(edges) == 2
    assert library.insert_citations(edges) == 0
    labels = spark.createDataFrame([("p1", "p2", "method"), ("x", "y", "none")], "citing string, cited string, context string")
    assert library.label_citations(labels) == 1
    assert {(r["cited"], r["context"]) for r in library.read("citations").collect()} == {("p2", "method"), ("p3", "")}


def hits(library, query, k=10):
    return [(r["id"], r["tier"], round(r["rank"], 9)) for r in library.search(query, k).collect()]


def by_all_rows(library, query, k=10):
    rows = search.search_merged(library.read("papers"), library.read("bodies"), query, k).collect()
    return [(r["id"], r["tier"], round(r["rank"], 9)) for r in rows]


QUERIES = ("quantum", "traps QUANTUM", "zzz", "ab", "ape")


def test_search_by_the_index_equals_search_of_all_rows(spark, library):
    library.set_body("p2", "a body on traps and quantum noise")
    library.set_body("p3", "another body, on traps alone")
    library.set_body("ghost", "traps of no paper")
    assert not library.index_is_fresh() and not library.refresh_index()
    plain = [hits(library, q) for q in QUERIES]
    library.rebuild_index()
    assert library.index_is_fresh() and [hits(library, q) for q in QUERIES] == plain == [by_all_rows(library, q) for q in QUERIES]


def test_index_follows_writes(spark, library):
    library.rebuild_index()
    rng = random.Random(3)
    for i in range(6):
        library.set_body(f"p{rng.randrange(4)}", " ".join(rng.choices(["traps", "quantum", "noise", "paper", "untrapped"], k=rng.randint(1, 12))))
        assert library.index_is_fresh()
        if i % 3 == 1:
            gone = rng.randrange(4)
            library.upsert("papers", library.read("papers").where(F.col("id") == f"p{gone}"), deleted=True)
            library.upsert("papers", spark.createDataFrame([(f"n{i}", f"New paper on traps {i}")], "id string, title string"))
        if i == 4:
            library.compact("bodies", 0)
            library.compact("papers", 0)
            assert library.index_is_fresh()
    assert [hits(library, q) for q in QUERIES] == [by_all_rows(library, q) for q in QUERIES]
    followed = library.index("papers").state(), library.index("bodies").state()
    assert len(library.index("bodies").log.live()) < 6  # segments were merged
    library.rebuild_index()
    again = library.index("papers").state(), library.index("bodies").state()
    assert [(x["n"], x["size"]) for x in followed] == [(x["n"], x["size"]) for x in again]


def test_index_that_missed_a_compaction_is_built_anew(library, monkeypatch):
    library.rebuild_index()
    with monkeypatch.context() as m:
        m.setattr(Library, "_follow", lambda self, table: None)
        library.set_keywords("p1", "fresh traps")
        library.compact("papers", 0)
        assert not library.index_is_fresh()
    assert [x[0] for x in hits(library, "fresh")] == ["p1"] and library.index_is_fresh()


def test_top_of_the_index_reads_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "FIRST", 4)
    rng = random.Random(7)
    rows = [(f"p{i:04d}", " ".join(rng.choices(["ion", "beam", "trap", "laser", "ionised"], weights=[1, 9, 9, 9, 1], k=rng.randint(2, 200)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "id string, body string")
    index = postings.WordIndex(spark, str(tmp_path / "ix"), ("body",))
    index.build(docs, 1)
    for query in ("ion", "ionised", "trap ion", "beam laser"):
        told = {}
        got = [(r["id"], round(r["rank"], 9)) for r in index.top(query, 5, told=told).orderBy("rank", "id").collect()]
        assert got == [(r["id"], round(r["rank"], 9)) for r in search.top(docs, query, 5, "id", ("body",)).collect()]
        assert told["blocks"] > 60 and told["read"] < told["blocks"] * (0.8 if " " in query else 0.5), (query, told)
    some = index.top("ion", 5, lambda r: r.where("id > 'p0400'")).collect()
    expected = search.ranked(docs, "ion", ("body",)).where("id > 'p0400'").orderBy("rank", "id").limit(5).collect()
    assert sorted(r["id"] for r in some) == sorted(r["id"] for r in expected)


def test_index_is_built_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Shuffles of all words, three for each segment, took more disk than there is for ten times the texts."""
    seen, write = [], CommitLog.write
    monkeypatch.setattr(CommitLog, "write", lambda self, rows, **options: (seen.append(rows), write(self, rows, **options))[1])
    text = lambda i: f"trap{i % 7} trap{i % 7} Ion\x00beam\x0bion of no\u00a0x {'ion ' * (i % 5)}" if i % 10 else None
    docs = spark.createDataFrame([(f"p{i}", text(i)) for i in range(60)], "id string, body string")
    former = docs.where("id > 'p3'").withColumn("body", F.concat(F.lit("ion before "), "body"))
    index = postings.WordIndex(spark, str(tmp_path / "ix"), ("body",))
    index.build(docs.where("id <= 'p3'").unionByName(former), 1)
    index.add(docs.where("id > 'p3'"), former, former.select("id"), 2)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in seen if "docs" in x.columns]
    assert len(plans) == 2 and not any("Exchange" in x for x in plans)
    for query in ("ion", "trap3 ion"):
        got = [(r["id"], round(r["rank"], 9)) for r in index.top(query, 9).orderBy("rank", "id").collect()]
        assert got == [(r["id"], round(r["rank"], 9)) for r in search.top(docs, query, 9, "id", ("body",)).collect()]


def test_index_reads_texts_once(spark, tmp_path):
    """Texts were read a second time for the number of rows and their sizes."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(f"p{i}", "ion trap " * i or None) for i in range(40)], "id string, body string")
    index = postings.WordIndex(spark, str(tmp_path / "ix"), ("body",))
    index.build(docs.mapInPandas(seen, docs.schema), 1)
    facts = docs.agg(F.count("*"), F.sum(F.greatest(F.length("body") - 2, F.lit(0)))).first()
    # once for the blocks, once for the ids, from which Spark can't leave out this function
    assert read.value == 80 and (index.state()["n"], index.state()["size"]) == tuple(facts)
    index.add(docs.where("id = 'p9'").withColumn("body", F.lit("ion")), docs.where("id in ('p9', 'p8')"), docs.where("id in ('p9', 'p8')").select("id"), 2)
    assert (index.state()["n"], index.state()["size"]) == (facts[0] - 1, facts[1] - (9 * 9 - 2) - (8 * 9 - 2) + 1)
    empty = postings.WordIndex(spark, str(tmp_path / "empty"), ("body",))
    empty.build(docs.where("false"), 1)
    assert (empty.state()["n"], empty.state()["size"]) == (0, 0) and empty.top("ion", 5).count() == 0


def test_blocks_hold_few_documents_and_little_text(monkeypatch):
    """Any task's memory is bounded, however its rows come."""
    monkeypatch.setattr(postings, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = [" ".join(["ion", "of", f"w{i:03d}"] * (1 + i // 4)) for i in range(40)]
    rows = [{"id": f"p{i}", "sign": 1, "size": len(t) - 2, "text": t, "tfs": None} for i, t in enumerate(texts)]
    kinds = pa.schema([("id", pa.string()), ("sign", pa.int32()), ("size", pa.int32()), ("text", pa.string()), ("tfs", pa.list_(pa.int64()))])
    made = [x.to_pylist() for x in postings.invert(pa.Table.from_pylist(rows, kinds).to_batches(max_chunksize=7), most=6, nbytes=500)]
    heads = [x[0] for x in made]
    assert [i for x in heads for i in x["ids"]] == [r["id"] for r in rows] and {x["token"] for x in heads} == {""}
    assert len({x["block"] for x in heads}) == len(made) and all(len({r["block"] for r in x}) == 1 for x in made)
    assert all(x["n"] <= 6 and sum(x["sizes"]) + 2 * x["n"] <= 500 for x in heads) and len(made) < 20
    got = {(r["token"], x[0]["ids"][d >> 32]): d & 0xFFFFFFFF for x in made for r in x[1:] for d in r["docs"]}
    assert got == {(w, f"p{i}"): 1 + i // 4 for i in range(40) for w in ("ion", f"w{i:03d}")}


def test_half_written_and_compacted_batches(spark, library):
    log = library.log("papers")
    before, at = sorted(r["id"] for r in library.read("papers").collect()), log.version()
    folder = library._write("papers", spark.createDataFrame([("half", "Not committed")], "id string, title string"))
    assert sorted(r["id"] for r in library.read("papers").collect()) == before
    library.upsert("papers", library.read("papers").where("id = 'p3'"), deleted=True)
    live = log.live()
    snapshot = library._write("papers", library.read("papers"))
    library.upsert("papers", spark.createDataFrame([("p9", "Meanwhile"), ("p0", "Changed")], "id string, title string"))
    log.commit(snapshot, replaces=live, order=live[-1]["order"], whole=log.version() - 1)
    state = {r["id"]: r["title"] for r in library.read("papers").collect()}
    assert sorted(state) == ["p0", "p1", "p2", "p9"] and state["p0"] == "Changed"
    with pytest.raises(Conflict):  # another compaction of the same batches
        log.commit(library._write("papers", library.read("papers")), replaces=live, order=live[-1]["order"])
    assert sorted(r["id"] for r in library.read("papers", at).collect()) == before  # an older snapshot, as long as its folders are kept
    library.compact("papers", 0)
    assert sorted(r["id"] for r in library.read("papers").collect()) == ["p0", "p1", "p2", "p9"]
    assert len(log._list("data")) == 1 and folder not in str(log._list("data"))


def test_writers_and_a_compaction_in_parallel_lose_nothing(spark, library):
    def write(name):
        for i in range(4):
            library.upsert("papers", spark.createDataFrame([(f"{name}{i}", f"By {name}")], "id string, title string"))

    def rate(stars):
        library.set_rating("p1", stars)

    jobs = [lambda: write("a"), lambda: write("b"), lambda: rate(3), lambda: library.set_status("p1", "read"), lambda: library.compact("papers"), lambda: library.compact("papers")]
    with ThreadPoolExecutor(6) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()
    assert library.read("papers").count() == 4 + 8
    row = paper(library, "p1")
    assert (row["rating"], row["status"]) == (3, "read")  # neither change overwrote the other
    library.compact("papers")
    assert library.read("papers").count() == 12


def test_stream(spark, library, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"title": "Fresh", "DOI": "10.9/a"}, {"title": "Fresh too", "DOI": "10.9/A"}, {"title": "Known", "DOI": "10.1/2"}]))
    for _ in range(2):
        imports.watch(library, str(folder), str(tmp_path / "state")).awaitTermination()
    assert library.read("papers").count() == 5


FEED = "<feed>{}</feed>"
ENTRY = "<entry><id>http://arxiv.org/abs/2301.{0}v1</id><title>Feed paper {0}</title><published>2023</published></entry>"


def test_streams_of_other_kinds(library, tmp_path):
    for name in ("feeds", "bib", "works"):
        (tmp_path / name).mkdir()
    (tmp_path / "feeds" / "a.XML").write_text(FEED.format(ENTRY.format(1) + ENTRY.format(2)))
    (tmp_path / "bib" / "a.bib").write_text("@article{a, title={From a file}, doi={10.1/2}}\n@article{b, title={New one}, doi={10.7/n}}")
    (tmp_path / "works" / "w.json").write_text(json.dumps({"results": [{"id": "https://openalex.org/W1", "doi": "10.7/N", "display_name": "The same"}, {"id": "https://openalex.org/W2", "display_name": "Work"}]}))
    run = lambda kind, name: imports.watch(library, str(tmp_path / name), str(tmp_path / f"state-{name}"), kind).awaitTermination()
    for kind, name, n in (("feed", "feeds", 6), ("bibtex", "bib", 7), ("openalex", "works", 8)):
        run(kind, name)
        assert library.read("papers").count() == n
    (tmp_path / "feeds" / "b.xml").write_text(FEED.format(ENTRY.format(2) + ENTRY.format(3)))
    run("feed", "feeds")
    assert library.read("papers").count() == 9
    with pytest.raises(Validation):
        imports.watch(library, str(tmp_path), str(tmp_path / "x"), "nothing")


def test_stream_batches_may_come_again_and_in_any_order(spark, tmp_path):
    files = [("f0", [{"title": "A", "DOI": "10.1/a"}, {"title": "B"}]), ("f1", [{"title": "Other a", "DOI": "doi:10.1/A"}, {"title": "b!"}]), ("f2", [{"title": "C", "DOI": "10.1/c"}])]
    kind = "file string, content string"
    states = []
    for n, order in enumerate(([0, 1, 2], [2, 1, 0])):
        lib = Library(spark, str(tmp_path / f"lib{n}"))
        batch = spark.createDataFrame([(files[i][0], json.dumps(files[i][1])) for i in order], kind)
        assert imports.store_new(lib, batch) == 3
        version = lib.log("papers").version()
        assert imports.store_new(lib, batch) == 0 and lib.log("papers").version() == version  # the batch again
        states.append(sorted((r["id"], r["title"], r["doi"]) for r in lib.read("papers").collect()))
    assert states[0] == states[1]
