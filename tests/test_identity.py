"""Identity rules, and the batch rule against one row at a time."""

import random

from stacklore.operators import identity

SCHEMA = "id string, title string, doi string, pdf_path string, seq long"


def by_hand(batch, library):
    stored, out, how = list(library), {}, {}
    doi = lambda d: (d or "").strip().removeprefix("doi:").strip().lower() or None
    name = lambda t: " ".join("".join(c for c in t if c.isalnum() or c.isspace()).split()).lower()
    for row in batch:
        _, title, d, path, _ = row
        hit, how[row[0]] = next((x for x in stored if doi(d) and doi(x[2]) == doi(d)), None), "doi"
        if not hit:
            hit, how[row[0]] = next((x for x in stored if path and x[3] == path), None), "path"
        if not hit and d is None and path is None and name(title):
            hit, how[row[0]] = next((x for x in stored if name(x[1]) == name(title)), None), "title"
        out[row[0]] = (hit[0], how[row[0]]) if hit else (None, None)
        if not hit:
            stored.append(row)
    return out


def test_precedence(spark):
    library = spark.createDataFrame([("a", "Same", "10.1/x", None, 1), ("b", "Other", None, "/p", 2), ("c", "Title here", "10.1/z", None, 3), ("d", "Same!", "doi:10.1/X", None, 4)], SCHEMA)
    rows = [("1", "z", "10.1/X", "/p", 1), ("2", "z", None, "/p", 2), ("3", "title HERE.", None, None, 3), ("4", "title here", " ", None, 4), ("5", "?", None, None, 5)]
    got = {r["id"]: (r["matched_id"], r["matched_by"]) for r in identity.resolve(spark.createDataFrame(rows, SCHEMA), library).collect()}
    assert got == {"1": ("a", "doi"), "2": ("b", "path"), "3": ("c", "title"), "4": (None, None), "5": (None, None)}


def test_batch_equals_one_at_a_time(spark):
    rng = random.Random(11)
    for _ in range(4):
        make = lambda p, n, at: [(f"{p}{i}", rng.choice(["A b", "a B!", "C", "d"]), rng.choice([None, None, "10.1/a", "doi:10.1/A", "10.1/b", " "]), rng.choice([None, None, "/p", "/q"]), at + i) for i in range(n)]
        library, batch = make("l", 2, 0), make("i", 12, 100)
        got = identity.resolve_batch(spark.createDataFrame(batch, SCHEMA), spark.createDataFrame(library, SCHEMA)).collect()
        expected = by_hand(batch, library)
        assert {r["id"]: r["is_new"] for r in got} == {k: v[0] is None for k, v in expected.items()}
        assert {r["id"]: (r["matched_id"], r["matched_by"]) for r in got} == expected


def test_an_identifier_of_the_batch_outranks_a_path_of_the_library(spark):
    library = spark.createDataFrame([("L1", "Old", None, "/a.pdf", 0)], SCHEMA)
    batch = spark.createDataFrame([("b1", "One", "10.1/x", None, 1), ("b2", "Two", "10.1/X", "/a.pdf", 2), ("b3", "Two", None, "/a.pdf", 3)], SCHEMA)
    got = {r["id"]: (r["matched_id"], r["matched_by"], r["is_new"]) for r in identity.resolve_batch(batch, library).collect()}
    assert got == {"b1": (None, None, True), "b2": ("b1", "doi", False), "b3": ("L1", "path", False)}


def test_many_rows_of_one_identifier_take_two_rounds(spark):
    batch = spark.createDataFrame([(f"b{i}", f"t{i}", "10.1/x", None, i) for i in range(3000)], SCHEMA)
    got = identity.resolve_batch(batch, batch.where("false"))
    assert got.where("is_new").count() == 1 and got.where("matched_id = 'b0' and matched_by = 'doi'").count() == 2999


def test_related_skips_itself(spark):
    library = spark.createDataFrame([("a", "W1", "10.1/x", 1), ("b", "https://openalex.org/W2", None, 2)], "id string, openalex_id string, doi string, seq long")
    rel = spark.createDataFrame([("a", "W1", None), ("a", "https://openalex.org/W2", "10.1/x"), ("b", None, "doi:10.1/X"), ("b", "W9", None)], "source_id string, openalex_id string, doi string")
    assert {(r["source_id"], r["paper_id"]) for r in identity.link_related(rel, library).collect()} == {("a", "b"), ("b", "a")}
