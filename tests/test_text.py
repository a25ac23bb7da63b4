"""Scalar functions on small literals."""

import pytest
from pyspark.sql import functions as F

from stacklore.functions import text as T


def one(spark, expr, *values):
    rows = spark.createDataFrame([(*values, 0)], [*(f"c{i}" for i in range(len(values))), "z"])
    return rows.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (T.normalize_doi, " https://doi.org/10.1/AB ", "10.1/ab"),
        (T.normalize_doi, "doi: 10.1/x", "10.1/x"),
        (T.normalize_doi, "DOI:10.1/x", "doi:10.1/x"),
        (T.normalize_doi, "  ", None),
        (T.normalize_title, "  A—B,  c!\tÉtude ", "ab c étude"),
        (T.work_id, "https://openalex.org/W12", "W12"),
        (T.work_id, "x/", None),
        (T.arxiv_id, "http://arxiv.org/abs/2301.00001v12", "2301.00001"),
        (T.split_keywords, "a, b;;c ", ["a", "b", "c"]),
        (T.year_from_text, "20130801", 801),
        (T.year_from_text, "123456", None),
        (T.year_from_text, "May 2019", 2019),
        (T.year_from_text, "0000", None),
        (T.paper_status, "nonsense", "discovered"),
        (T.gap_type, "connection_gap", "connection_gap"),
        (T.rating, 6, None),
        (T.rating, 5, 5),
        (T.anchor_section, "## One\nx\n## Two \ny", "Two"),
        (T.anchor_section, "no heading", None),
        (T.anchor_page, "<!-- page 3 -->\na\n<!-- page x\n<!-- page 12", 12),
        (T.prepare_body, "Abstract:  \ntext  \n RESULTS \nresults matter", "\n## Abstract\n\ntext\n## RESULTS\n\nresults matter"),
        (T.prepare_body, " \n ", None),
        (T.percent_encode, "a b*~é", "a+b%2A~%C3%A9"),
        (T.safe_filename, "a/b c.pdf", "abc.pdf"),
        (T.priority, 7.0, 1.0),
        (T.comma_list, "a, b", ["a", "b"]),
    ],
)
def test_scalars(spark, f, value, expected):
    got = one(spark, f, value)
    if f is T.prepare_body and expected:
        assert got.split() == expected.split() and "\n## RESULTS" in got
    else:
        assert got == expected


def test_several_arguments(spark):
    assert one(spark, T.merge_tags, [" a", "b"], ["b ", "", "c"]) == ["a", "b", "c"]
    assert one(spark, T.intent_label, ["background", "method"], True) == "background+method+influential"
    assert one(spark, T.join_pages, ["a\n", "b"]) == "<!-- page 1 -->\na\n<!-- page 2 -->\nb\n"
    assert one(spark, T.abstract_rebuild, {"b": [1, 3], "a": [0], "c": [2]}) == "a b c b"
    assert one(spark, T.author_name, " Ada ", "", "Lovelace") == "Ada Lovelace"
    assert one(spark, T.place, "Results", 3) == "(Results, p.3)"


def test_reports(spark):
    got = one(spark, T.report_sections, "# T\nlead\n## A \n x \n\n## B\n")
    assert [tuple(r) for r in got] == [("A", "x"), ("B", "")]
    assert [tuple(r) for r in one(spark, T.report_sections, "# T\n\nplain")] == [("Overview", "plain")]
    assert one(spark, T.report_sections, " \n") == []
    assert [tuple(r) for r in one(spark, T.sections_for_saving, "lead\n## A\n\nx\ny ")] == [("", "lead"), ("A", "x\ny ")]


def test_reply_lines(spark):
    assert [tuple(r) for r in one(spark, T.gap_lines, "hi\nMissingLiterature| a|b \nOther|x")] == [("missing_literature", "a|b")]
    assert [tuple(r) for r in one(spark, T.keyword_lines, "p1| a; b\n|x\np2|")] == [("p1", "a; b")]
