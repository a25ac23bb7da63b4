"""The library in use, from import to report."""

import json

import pytest

from stacklore.app import Research, main
from stacklore.config import Settings
from stacklore.errors import Config, NotFound, Serialization, Validation
from stacklore.sources import json_items


@pytest.fixture(scope="module")
def research(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("app")
    (base / "in").mkdir()
    (base / "in" / "a.bib").write_text("@article{x, title={Ion traps at work}, doi={10.1/a}, year=2020, author={Doe, Jane}}")
    (base / "in" / "b.json").write_text(json.dumps([{"title": "Ion traps again", "DOI": "10.1/A"}, {"title": "Laser noise", "DOI": "10.1/b"}]))
    r = Research(spark, str(base / "lib"))
    r.top = r.topic_add("Physics")
    r.done = r.import_papers(str(base / "in"), r.top)
    return r


def test_import_and_search(research):
    assert research.done == {"imported": 2, "skipped_duplicates": 1, "failed": []}
    assert [x["title"] for x in research.query("traps").collect()] == ["Ion traps at work"]
    assert research.missing_keywords(5, research.top).count() == 2 and research.stalest(5).count() == 2
    key = research.query("laser").first()["id"]
    research.library.set_body(key, "<!-- page 1 -->\n## Results\nthe laser is quiet")
    assert [(x["section"], x["page"]) for x in research.evidence("quiet").collect()] == [("Results", 1)]
    with pytest.raises(NotFound):
        research.references("nobody")


def test_topics_gaps_reports(research):
    below = research.topic_add("Ions", research.top)
    assert {x["id"]: x["depth"] for x in research.topics().collect()} == {research.top: 0, below: 1}
    with pytest.raises(Validation):
        research.topic_add("x", "nobody")
    assert research.record_gaps(research.top, [{"description": " a gap ", "gap_type": "?", "priority": 3.0}, {"description": " "}]) == 1
    assert [(x["description"], x["gap_type"], x["priority"]) for x in research.gaps(research.top).collect()] == [("a gap", "missing_literature", 1.0)]
    brief = research.brief(research.top).first()
    assert len(brief["papers"]) == 2 and brief["state"]["gaps_identified"] == 1
    research.report_save("R", [research.top], "lead\n## One\ntext")
    assert research.library.reports().first()["sections"][-1]["heading"] == "One"
    counts = research.overview().first()
    assert (counts["topics"], counts["papers"], counts["gaps"], counts["reports"]) == (2, 2, 1, 1)
    assert research.history().count() == 4


def test_commands_and_settings(research, tmp_path, capsys):
    main([research.library.root, "query", "laser"])
    assert "Laser noise" in capsys.readouterr().out
    file = str(tmp_path / "c" / "settings.toml")
    assert Settings.load_or_create(file) == Settings.load_or_create(file) == Settings()
    (tmp_path / "bad.toml").write_text("= =")
    with pytest.raises(Config):
        Settings.load_or_create(str(tmp_path / "bad.toml"))


@pytest.mark.parametrize("large", [json_items.LARGE, 20])
def test_a_bad_file_is_listed_and_the_others_count(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(json_items, "LARGE", large)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('[{"title": "cut')
    (folder / "b.json").write_text('[{"itemType": ')
    (folder / "c.json").write_text(json.dumps([{"itemType": "article", "title": "Fine"}]))
    (folder / "d.json").write_text(json.dumps({"title": "no list"}))
    (folder / "e.json").write_text(json.dumps([{"itemType": "article", "title": "With a bad one"}, 5]))
    (folder / "f.json").write_text("[1, 2]")
    done = Research(spark, str(tmp_path / "lib")).import_papers(str(folder))
    assert done["imported"] == 1 and [x.rsplit("/", 1)[1] for x in done["failed"]] == ["a.json", "b.json", "d.json", "e.json", "f.json"]


def test_ingest_references_intents_and_replies(spark, tmp_path):
    def land(name, *answers):
        (tmp_path / name).mkdir()
        for i, x in enumerate(answers):
            (tmp_path / name / f"{i}.json").write_text(json.dumps(x))
        return str(tmp_path / name)

    work = lambda i: {"id": f"https://openalex.org/W{i}", "doi": f"https://doi.org/10.1/{i}", "display_name": f"Work {i}", "publication_year": 2000 + i}
    page_rows = spark.createDataFrame([("/a/Scan.pdf", 1, "Results\nquiet lasers")], "file string, page int, text string")
    page_rows.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "feed.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2301.1v2</id><title>From a feed</title><published>2023</published></entry></feed>")
    r = Research(spark, str(tmp_path / "lib"))
    topic = r.topic_add("T")
    epmc = {"resultList": {"result": [{"id": "9", "source": "PPR", "title": "Pre"}, {"id": "8", "source": "MED", "title": "Med"}]}}
    done = r.ingest([("openalex", land("oa", {"results": [work(1), work(2), work(3)]})), ("nowhere", "x"), ("europe_pmc", land("ep", epmc)), ("atom", str(tmp_path / "missing.xml")), ("atom", str(tmp_path / "feed.xml")), ("pages", str(tmp_path / "pages"))], topic)
    assert (done["imported"], done["skipped_duplicates"], len(done["failed"])) == (7, 0, 2)
    assert r.ingest([("preprints", str(tmp_path / "ep"))], topic)["skipped_duplicates"] == 1
    assert [x["place"] for x in r.evidence("quiet").collect()] == ["(Results, p.1)"]
    ids = {x["title"]: x["id"] for x in r.library.read("papers").collect()}
    assert r.sync_references(ids["Work 1"], land("refs", {"results": [work(2), work(9)]})) == 1
    assert r.sync_references(ids["Work 1"], land("citers", {"results": [work(3), work(1)]}), cited_by=True) == 1
    edge = lambda way, doi, *intents: {"data": [{"intents": list(intents), "isInfluential": False, way: {"paperId": "q", "externalIds": {"DOI": doi}}}]}
    assert r.sync_intents(ids["Work 1"], land("in1", edge("citedPaper", "10.1/2", "method"))) == 1
    assert r.sync_intents(ids["Work 1"], land("in2", edge("citingPaper", "10.1/3", "background")), cited_by=True) == 1
    assert r.sync_intents(ids["Work 1"], land("in3", edge("citedPaper", "10.1/2"))) == 0
    assert {(x["citing"], x["cited"], x["context"]) for x in r.library.read("citations").collect()} == {(ids["Work 1"], ids["Work 2"], "method"), (ids["Work 3"], ids["Work 1"], "background")}
    assert r.keyword_reply(f"Sure\n{ids['Work 1']}| a; b") == 1 and r.gap_reply(topic, "MissingLiterature|none on x") == 1
    for bad in (lambda: r.keyword_reply("nothing"), lambda: r.gap_reply(topic, "nothing")):
        with pytest.raises(Serialization):
            bad()


def test_json_output(research, capsys):
    main([research.library.root, "query", "laser", "--json"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["title"] == "Laser noise"
