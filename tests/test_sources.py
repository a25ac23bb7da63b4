"""Parsers on small files of every format."""

import json
import random

import pytest

from stacklore.errors import Source
from stacklore.sources import atom, bibtex, json_items, json_sources, pages

BIB = """
@string{jn = "Journal of " # {Tests}}
@article{a1, title = {A {Nested} Title}, author = "Doe, Jane and {van} Gogh, Vincent and Plato", year = 2019, journal = jn, doi = {https://doi.org/10.1/AB}, keywords = {x; y, z}}
@misc{a2, author = {No Title}}
@book(a3, title = "Range", date = {2001/2003}, booktitle={B})
"""


def docs(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)], "file string, content string")


def test_bibtex(spark):
    got = bibtex.parse(docs(spark, BIB)).collect()
    assert [(r["title"], r["year"], r["doi"]) for r in got] == [("A Nested Title", 2019, "10.1/ab"), ("Range", 2001, None)]
    assert got[0]["authors"] == ["Jane Doe", "Vincent van Gogh", "Plato"] and got[0]["venue"] == "Journal of Tests" and got[0]["tags"] == ["x", "y", "z"]


def test_csl_and_zotero(spark):
    csl = [{"title": "One", "issued": {"date-parts": [["2020", 1]]}, "author": [{"given": "A", "family": "B"}], "container-title": "V"}, {"title": "Two", "issued": {"date-parts": [[1999]]}}, {"title": " "}]
    flat = [{"itemType": "article", "title": "Three", "date": "May 2011", "creators": [{"firstName": "X", "lastName": "Y"}, {"name": "Org"}], "tags": [{"tag": " t "}, {"tag": ""}]}, {"itemType": "attachment", "title": "file"}]
    nested = [{"key": "K", "version": 3, "data": {"itemType": "article", "title": "Four", "DOI": "10.1/Q"}}]
    got = {r["title"]: r for r in json_sources.bibliography(docs(spark, csl, flat, nested)).collect()}
    assert set(got) == {"One", "Two", "Three", "Four"}
    assert (got["One"]["year"], got["Two"]["year"], got["Three"]["year"]) == (2020, 1999, 2011)
    assert got["Three"]["authors"] == ["X Y", "Org"] and got["Three"]["tags"] == ["t"] and got["Four"]["doi"] == "10.1/q"
    assert json_sources.remote_items(docs(spark, nested)).first()["version"] == 3
    with pytest.raises(Source):
        json_sources.zotero(docs(spark, '[{"itemType": ')).collect()


def test_services(spark):
    work = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "display_name": "W", "publication_year": 2001, "authorships": [{"author": {"display_name": "N"}}], "abstract_inverted_index": {"b": [1], "a": [0]}, "referenced_works": ["https://openalex.org/W2"]}
    row = json_sources.openalex(docs(spark, {"results": [work, {"id": "x"}]})).collect()
    assert [(r["title"], r["abstract_text"], r["openalex_id"]) for r in row] == [("W", "a b", "W1")]
    assert [tuple(r) for r in json_sources.openalex_references(docs(spark, work)).collect()] == [("W1", "W2")]
    epmc = {"resultList": {"result": [{"id": "9", "source": "PPR", "title": "E", "pubYear": "2010"}, {"id": "8", "source": "MED", "title": "F"}]}}
    assert json_sources.europe_pmc(docs(spark, epmc)).count() == 2
    assert [r["url"] for r in json_sources.europe_pmc(docs(spark, epmc), True).collect()] == ["https://europepmc.org/article/PPR/9"]
    s2 = {"data": [{"paperId": "s", "title": None, "externalIds": {"ArXiv": "1", "DOI": "10.1/Y"}}]}
    assert [(r["title"], r["doi"]) for r in json_sources.semantic_scholar(docs(spark, s2)).collect()] == [("", "10.1/y")]
    edges = {"data": [{"intents": ["method"], "isInfluential": True, "citingPaper": {"paperId": "q", "externalIds": {"DOI": "10.1/Z"}}}]}
    assert [(r["doi"], r["label"]) for r in json_sources.citation_intents(docs(spark, edges)).collect()] == [("10.1/z", "method+influential")]


def test_atom_and_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2301.1v2</id><title>A &amp;\n B</title><summary> S </summary><published>2023-01-01</published><author><name>N M</name></author></entry></feed>")
    row = atom.read(spark, str(tmp_path / "feed.xml")).first()
    assert (row["title"], row["arxiv_id"], row["year"], row["authors"]) == ("A & B", "2301.1", 2023, ["N M"])
    (tmp_path / "x.JSON").write_text("[]")
    assert json_sources.read_documents(spark, str(tmp_path)).count() == 1


def test_pages(spark):
    rows = spark.createDataFrame([("/a/My.PDF", 2, "Results\nx"), ("/a/My.PDF", 1, "Lead  words\n")], "file string, page int, text string")
    row = pages.papers_and_bodies(rows).first()
    assert row["title"] == "My" and row["abstract_text"].startswith("Lead words") and "## Results" in row["body"]


def test_one_bad_item_fails_its_document_alone(spark):
    good, flat = [{"title": "Fine"}], [{"itemType": "article", "title": "Good"}]
    all_docs = docs(spark, good, [{"itemType": "article", "title": "x"}, 5], [1, 2], [], flat, [{"title": "x"}, None], {"title": "x"}, '[{"title"')
    assert {r["title"] for r in json_sources.bibliography(all_docs).collect()} == {"Fine", "Good"}
    assert sorted(r["file"] for r in json_sources.unreadable(all_docs).collect()) == ["f1", "f2", "f5", "f6", "f7"]


def test_remote_pages_with_a_limit(spark):
    page = lambda a, b: [{"key": f"K{i}", "version": 1, "data": {"itemType": "attachment" if i % 4 == 1 else "article", "title": f"Title {i:03d}"}} for i in range(a, b)]
    pages = docs(spark, page(0, 10), page(10, 20), page(20, 25))
    assert [r["title"] for r in json_sources.remote_papers(pages, 12).orderBy("title").collect()] == [f"Title {i:03d}" for i in range(25) if i % 4 != 1][:12]
    assert json_sources.remote_papers(pages).count() == len([i for i in range(25) if i % 4 != 1])
    with pytest.raises(Source):
        json_sources.remote_papers(docs(spark, page(0, 2), [5]), 3)


def test_items_of_large_arrays(spark, tmp_path):
    rng = random.Random(6)
    odd = ['a "quoted" } brace', "[x] {y}", "back\\slash", 'end\\"', "é}😀", "", "line\nbreak"]
    items = [{"title": f"T{i} " + rng.choice(odd), "abstract": rng.choice(odd), "author": [{"given": "A", "family": rng.choice(odd)}] * rng.randint(0, 3), "issued": {"date-parts": [[2000 + i % 20]]}} for i in range(400)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(items))
    (folder / "b.json").write_text(json.dumps(items[:40], indent=2, ensure_ascii=False) + "\n")
    (folder / "c.json").write_text(" [ ] ")
    (folder / "d.json").write_text(json.dumps([{"itemType": "article", "title": "Z", "data": None}, {"itemType": "note", "title": "no"}]))
    for name, text in {"e": '[{"title": "x"}, 5, {"title": "y"}]', "f": "[1, 2]", "g": '[{"title": "cut"', "h": '{"title": "no list"}', "i": '[{"title": "x"}', "j": '[{"title": "x"}, 7]', "k": '[{"title": "a"} {"title": "b"}]'}.items():
        (folder / f"{name}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # a.json lies in many parts
    try:
        found = json_items.read_items(spark, str(folder))
        whole = json_sources.read_documents(spark, str(folder))
        shown = ("title", "abstract_text", "authors", "year")
        got = sorted(map(str, json_items.bibliography(found).select(*shown).collect()))
        assert got == sorted(map(str, json_sources.bibliography(whole).select(*shown).collect())) and len(got) == 441
        name = lambda rows: {r["file"].rsplit("/", 1)[1] for r in rows.collect()}
        assert name(json_items.failures(found)) == name(json_sources.unreadable(whole)) == {f"{x}.json" for x in "efghijk"}
        assert [r["item"] for r in json_items.failures(found).where("file like '%e.json'").collect()] == [1]
        assert spark.read.option("lineSep", "}").text(str(folder / "a.json")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
