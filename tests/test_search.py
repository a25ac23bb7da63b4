"""Ranking against SQLite's own trigram index, and evidence."""

import random
import sqlite3

import pytest

from stacklore.operators import search

WORDS = "ion beam trap laser qubit noise gate phase lattice cavity photon Schrödinger état".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(f"p{i}", " ".join(rng.choices(WORDS, k=rng.randint(3, 9))), " ".join(rng.choices(WORDS, k=rng.randint(5, 40))), "", [rng.choice(WORDS)], "") for i in range(200)]


@pytest.fixture(scope="module")
def papers(spark, corpus):
    return spark.createDataFrame(corpus, "id string, title string, abstract_text string, notes string, tags array<string>, keywords string")


@pytest.mark.parametrize("query", ["qubit", "Laser noise", '"ion" beam', "état", "zzz", "tice cav", "ga"])
def test_rank_equals_fts5(corpus, papers, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, abstract, notes, tags, keywords, tokenize='trigram')")
    db.executemany("INSERT INTO f(rowid, title, abstract, notes, tags, keywords) VALUES (?, ?, ?, ?, ?, ?)", [(i, t, a, n, "[" + ",".join(f'"{x}"' for x in g) + "]", k) for i, (_, t, a, n, g, k) in enumerate(corpus)])
    match = " ".join(f'"{t}"' for t in search.query_terms(query))
    expected = dict(db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,)).fetchall()) if match else {}
    got = {int(r["id"][1:]): r["rank"] for r in search.ranked(papers, query).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_overlaps_count(spark):
    rows = spark.createDataFrame([("aaaa",)], ["x"])
    assert rows.select(search.occurrences(rows["x"], "aaa")).first()[0] == 2


def test_merge_keeps_metadata_first(spark, papers):
    bodies = spark.createDataFrame([("p0", "the qubit body"), ("p1", "rareword here"), ("ghost", "rareword")], ["paper_id", "body"])
    got = search.search_merged(papers, bodies, "rareword", 5).collect()
    assert [(r["id"], r["tier"]) for r in got] == [("p1", 1)]


def test_evidence_is_scoped_before_the_limit(spark, papers):
    marked = "<!-- page 1 -->\n## Methods\nnothing\n<!-- page 2 -->\n## Results\nthe ION beam won"
    bodies = spark.createDataFrame([("p0", marked), *[(f"p{i}", "ion " * 30) for i in range(1, 30)]], ["paper_id", "body"])
    got = search.evidence(papers, bodies, "ion", 1, "p0").collect()
    assert [(r["paper_id"], r["section"], r["page"]) for r in got] == [("p0", "Results", 2)]
    assert "[ION]" in got[0]["snippet"]


def windows(body, terms):
    """All windows that begin at a match, by brute force: where the best one begins."""
    low, best = body.lower(), None
    found = [(i, min(i + len(t), i + search.SNIPPET), k) for k, t in enumerate(terms) for i in range(len(low)) if low.startswith(t, i)]
    for p in sorted({m[0] for m in found}):
        inside = [m for m in found if p <= m[0] and m[1] <= p + search.SNIPPET]
        score = (len({m[2] for m in inside}), len(inside), -p)
        best = max(best or score, score)
    return -best[2]


@pytest.mark.parametrize("query", ["ion beam", "aa aaa", "noise trap ion", "averylongtermthatislongerthanasnippetis ion"])
def test_evidence_windows_against_all_windows(spark, papers, query):
    rng, terms = random.Random(8), search.query_terms(query)
    pieces = [*terms, "x" * 7, "a", "filler text", "\n", "İ" if query == "ion beam" else "i"]
    bodies = {f"p{i}": "ion " + " ".join(rng.choices(pieces, k=rng.randint(1, 60))) + " " + " ".join(terms) for i in range(25)}
    got = search.evidence(papers, spark.createDataFrame(list(bodies.items()), ["paper_id", "body"]), query, 100).collect()
    assert len(got) == 25
    for r in got:
        body = bodies[r["paper_id"]]
        body = body if len(body) == len(body.lower()) else body.lower()
        at = windows(body, terms)
        shown = r["snippet"].removeprefix("…").removesuffix("…")
        plain = shown.replace("[", "").replace("]", "")
        assert len(plain) <= search.SNIPPET and plain in body
        assert shown.index("[") + body.index(plain, max(at - search.LEAD, 0)) == at  # the first bracket is at the window's first match


def test_evidence_of_many_matches_is_linear(spark, papers):
    bodies = spark.createDataFrame([("p0", "ion beam " * 30_000)], ["paper_id", "body"])
    assert search.evidence(papers, bodies, "ion beam", 1).first()["snippet"].startswith("[ion] [beam]")


def test_evidence_anchors_the_shown_match(spark, papers):
    body = "<!-- page 1 -->\n## Introduction\nbackground material\n<!-- page 3 -->\n## Results\nthe ion beam produced clean output\n"
    row = search.evidence(papers, spark.createDataFrame([("p0", body)], ["paper_id", "body"]), "ion beam", 10).first()
    assert (row["section"], row["page"]) == ("Results", 3) and "[ion] [beam]" in row["snippet"]
