"""What a search has to find in a small library, without and with keywords, by all rows and by the index."""

import pytest

from stacklore.library import Library
from stacklore.schema import PAPERS

#: title, abstract, keywords: written for this test.
ROWS = [
    ("Reading only where it matters", "A decoder that weighs all source positions before each word.", "attention; seq2seq; neural translation"),
    ("Clocks that agree to disagree", "Ordering events of several replicas without a shared clock.", "lamport time; causality"),
    ("Deep stacks see pictures", "Layers of learned filters name what photographs show.", "image recognition; imagenet"),
    ("Shortcuts for image recognition", "Adding a layer's input to its output lets very deep stacks train.", "residual network"),
    ("Leases and how to lose them", "A lock with an end survives the loss of its holder.", "fault tolerance; mutual exclusion"),
    ("Steps sized by past gradients", "Each weight keeps its own pace of descent.", "adaptive learning rate; optimiser"),
    ("Sketches of heavy streams", "Counting frequent items in little memory.", "count-min; approximate counting"),
    ("Ledgers nobody owns", "Strangers agree on an order of payments.", "blockchain; proof of work"),
]


@pytest.fixture(scope="module", params=[False, True], ids=["all rows", "index"])
def libraries(request, spark, tmp_path_factory):
    made = []
    for enriched in (False, True):
        library = Library(spark, str(tmp_path_factory.mktemp("golden") / "lib"))
        rows = [{**dict.fromkeys(PAPERS.names), "id": f"p{i}", "title": t, "abstract_text": a, "keywords": k if enriched else "", "tags": []} for i, (t, a, k) in enumerate(ROWS)]
        library.upsert("papers", spark.createDataFrame(rows, PAPERS))
        if request.param:
            library.rebuild_index()
            assert library.index_is_fresh()
        made.append(library)
    return made


def rank(library, query, i):
    found = [r["id"] for r in library.search(query, 10).collect()]
    return found.index(f"p{i}") if f"p{i}" in found else None


@pytest.mark.parametrize(("query", "i"), [("image recognition", 3), ("heavy streams", 6), ("shared clock", 1), ("PAYMENTS", 7)])
def test_words_of_a_text_are_found_without_keywords(libraries, query, i):
    assert rank(libraries[0], query, i) in (0, 1, 2)


@pytest.mark.parametrize(("query", "i"), [("seq2seq", 0), ("fault tolerance", 4), ("adaptive learning rate", 5), ("blockchain", 7), ("count-min", 6)])
def test_other_words_need_keywords(libraries, query, i):
    assert rank(libraries[0], query, i) is None and rank(libraries[1], query, i) in (0, 1, 2)


def test_keywords_do_not_push_titles_away(libraries):
    assert rank(libraries[1], "image recognition", 2) in (0, 1, 2) and rank(libraries[1], "image recognition", 3) in (0, 1, 2)


def test_new_keywords_replace_the_old_ones(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    library.upsert("papers", spark.createDataFrame([{**dict.fromkeys(PAPERS.names), "id": "p0", "title": "T", "abstract_text": "a", "keywords": "transformer", "tags": []}], PAPERS))
    library.rebuild_index()
    assert rank(library, "transformer", 0) == 0
    library.set_keywords("p0", "attention model")
    assert rank(library, "transformer", 0) is None and rank(library, "attention", 0) == 0
