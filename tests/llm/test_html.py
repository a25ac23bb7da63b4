"""Text extraction on pages of several shapes."""

import html as h
import re
import time
from collections import Counter

import pytest

from stacklore.llm import html_pages, html_text

TEXT = "A sentence of the article that goes on for quite some words, so that it counts."
BOXES = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>", "<header><a href='/'>Site name</a> <p>A line about the site</p></header>", "<footer>&copy; someone and all rights and more words</footer>", "<aside><p>Other things to read here today</p></aside>",
    "<div class='ad'>Buy this thing now and save a lot</div>", "<div class='cookie-notice'><p>We use cookies to make things better for you</p></div>", "<form><p>Sign up for our letter</p><input><button>Go</button></form>", "<script>var x = '</p> not text';</script>", "<style>p{color:red}</style>",
    "<section id='comments'><p>First comment by a reader of this page</p></section>", "<!-- a comment -->",
]


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("outer", ["article", "main", "div id='content'"])
def test_boxes_go(box, outer):
    name = outer.split()[0]
    page = f"<html><head><title>T</title></head><body>{box}<{outer}><h1>Head &amp; line</h1><p>{TEXT}</p>{box}<p>{TEXT} <a href='x'>link</a>\n  end&nbsp;x</p><ul><li>one thing</li></ul></{name}>{box}</body></html>"
    assert html_text.main_text(page, html_text.learned()) == f"Head & line\n\n{TEXT}\n\n{TEXT} link end x\n\none thing"


def test_broken_markup_and_depth():
    w = html_text.learned()
    assert html_text.main_text("<p>one two three<p>four <b>five<br>six", w) == "one two three\n\nfour five six"
    assert html_text.main_text("", w) == "" and html_text.main_text("plain words only", w) == "plain words only"
    assert html_text.main_text("<div>" * 20_000 + "some words in the deep" + "</div>" * 20_000, w) == "some words in the deep"
    assert "1 < 2" in html_text.main_text("<p>we know that 1 < 2 and so on", w)


def test_tables(spark, smallest):
    pages = spark.read.parquet(f"{smallest}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)
        blocks = (re.sub(r"\s+", " ", h.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", inner[1]))
        assert got[r["page_id"]]["text"] == "\n\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string").selectExpr("*", "1 AS n_chars", "html AS weights")
    assert [r["text"] for r in html_text.extract_text(odd).collect()] == ["", "", ""]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_raw_elements_end_at_their_end_tag():
    w = html_text.learned()
    codes = ["for(var i=0;i<n;i++){f(i)}", "if(a<b && c>d) x = '<p>no</p>';", "/* it's */ y = i<n"]
    for box in [f"<script>{code}</SCRIPT >" for code in codes] + ["<style>a<b{}</style>", "<textarea>a <b c</textarea>", "<svg><!-- </svg> --><script>i<n</script></svg>"]:
        assert html_text.main_text(f"<html><body>{box}<article><p>{TEXT}</p>{box}<p>{TEXT}</p></article></body></html>", w) == f"{TEXT}\n\n{TEXT}"
    for name in ("title", "iframe", "noscript", "select"):
        assert TEXT in html_text.main_text(f"<html><body><{name}><article><p>{TEXT}</p></article></body></html>", w)
    assert html_text.main_text(f"<p>{TEXT}</p><script>never ends <p>{TEXT}</p>", w) == TEXT
    assert html_text.main_text("<select>" * 20_000 + f"<p>{TEXT}</p>", w) == TEXT


def test_unseen_labelled_pages():
    """Words of pages that the weights weren't learned from, by their labels."""
    right = wrong = missed = 0
    for seed in range(50_000, 50_120):
        page = html_pages._Writer(seed).page()
        cut = html_text.parsed(page)
        label = [False] * len(cut.elements)
        for i, e in enumerate(cut.elements[1:], 1):
            label[i] = label[e.parent] if e.label is None else e.label
        true = Counter(w for kind, text, e, _ in cut.items if kind == "w" and label[e] for w in text.split())
        got = Counter(html_text.main_text(page, html_text.learned()).split())
        right, wrong, missed = right + (true & got).total(), wrong + (got - true).total(), missed + (true - got).total()
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.92


@pytest.mark.parametrize("names", [("qq", "zz", "yy"), ("k-1", "k-2", "k-3"), ("left", "middle", "right")])
def test_shape_decides_where_names_say_nothing(names):
    a, b, c = names
    links = " ".join(f"<a href='/{i}'>Go {i}</a>" for i in range(6))
    page = f"<body><div class='{a}'>{links}</div><div class='{b}'><h2>Head</h2><p>{TEXT} {TEXT}</p><p>{TEXT}</p></div><div id='{c}'><ul>{links}</ul></div></body>"
    assert html_text.main_text(page, html_text.learned()) == f"Head\n\n{TEXT} {TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("name", ["header-image", "search-results", "related-work", "tags", "menu-of-the-day", "advertising-history"])
def test_paragraphs_of_an_article_stay_whatever_their_box_is_called(name):
    page = f"<body><article><p>{TEXT}</p><div class='{name}'><p>{TEXT}</p></div><p>{TEXT}</p></article></body>"
    assert html_text.main_text(page, html_text.learned()) == "\n\n".join([TEXT] * 3)


def test_cut_and_broken_pages_take_no_time():
    w, begin = html_text.learned(), time.perf_counter()
    for broken in ("<a" + " " * 10_000, '<img alt="open' + " " * 10_000, "<img alt='open > x" + " " * 10_000, "<a <a " * 5000, '<a x="' * 5000, "<a x='<a y=\"'" * 5000, "<!--" * 5000, "<" * 10_000, "</" * 10_000, "<title>" * 5000, '<p class="' + "a " * 10_000):
        assert html_text.main_text(f"<article><p>{TEXT}</p><p>{TEXT}</p>{broken}", w).startswith(f"{TEXT}\n\n{TEXT}")
    assert time.perf_counter() - begin < 10
    page = f'<script>var q = "it is <b";</script><article class="post"><p>{TEXT}</p></article>'
    assert html_text.main_text(page, w) == TEXT
    assert html_text.main_text(f"<article><p title=a\"b>{TEXT}</p><p title='>'>{TEXT}</p></article>", w) == f"{TEXT}\n\n{TEXT}"


def test_a_region_is_the_best_run():
    """Scores of the chosen items sum to the greatest sum of any run."""
    w = html_text.learned()
    for seed in range(60_000, 60_040):
        page = html_pages._Writer(seed).page()
        items = html_text.sequence(page, w)
        a, b = html_text.best_run([x[2] for x in items])
        sums = [0.0]
        for x in items:
            sums.append(sums[-1] + x[2])
        assert sums[b] - sums[a] == pytest.approx(max(sums[j] - sums[i] for i in range(len(sums)) for j in range(i, len(sums))))
