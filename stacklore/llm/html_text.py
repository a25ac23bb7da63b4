"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is the log-odds, learned from labelled pages, that it is content,
given the elements around it, their names and share of links, and the shape of its block; a tag costs what tags cost
there. What stands in boxes that are hardly ever content isn't part of the sequence; the text is all of its best
contiguous region, found by one linear scan.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, texts_of
from .html_pages import labelled_pages

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("title script style noscript template iframe object svg math canvas audio video textarea select".split())
#: Those of RAW whose content isn't markup at all; a script without an end goes on to the end of the page.
PLAIN = frozenset("title script style noscript iframe textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
ENDS_P = BLOCKS - {"body", "head", "html", "title", "td", "th", "tr", "option"}
SECTIONS = frozenset("article main section nav aside header footer form dialog".split())
#: Names that say nothing about their words.
MUTE = frozenset("html body div span a b i em strong small u s font code q cite abbr sub sup mark time tt kbd var big center tbody tr table".split())

NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
TAG_STOP = re.compile(r"""=\s*["']|>""")
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>/=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
LABEL = re.compile(r"""\sdata-main(?:="(no)")?""")
WHITE = re.compile(r"\s+")

#: Least and greatest score of a word and of a tag; log-odds below which a word isn't part of the sequence.
WORD_RANGE, TAG_RANGE, LEFT_OUT = (-1.5, 1.5), (-0.1, -0.01), -0.5
#: Links, and share of words inside them, from which an element is a list of links.
MANY_LINKS, LINK_SHARE = 2, 0.6
STEPS, RATE, RIDGE, LEAST_PAGES, LEAST_WEIGHT = 700, 0.1, 3e-6, 4, 0.05


@lru_cache(4096)
def features(tag: str) -> tuple[str, ...]:
    """The element's name, its role, and of each class and id the last word and, if there are more, the first: the last
    says what a thing is, the others what it is about."""
    name = NAME.match(tag)[1].lower()
    found = [] if name in MUTE else [name]
    for kind, *values in MARKS.findall(tag):
        for one in "".join(values).split():
            parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one).lower()) if x]
            if kind.lower() == "role":
                found += [f"role:{x}" for x in parts]
            elif parts:
                found += [f"last:{parts[-1]}", *([f"first:{parts[0]}"] if len(parts) > 1 else [])]
    if HIDDEN.search(tag):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


def tag_end(page: str, at: int) -> int:
    """The place after a tag that begins at ``at``; -1 if the page ends inside it. Quotes count after an equals sign. One
    that never closes is no quote, which can happen once for each kind, so that all scans together are linear."""
    while stop := TAG_STOP.search(page, at):
        at = stop.end()
        if stop[0] == ">":
            return at
        if (close := page.find(stop[0][-1], at)) >= 0:
            at = close + 1
    return -1


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    """The end tag of a RAW element; where the content is markup, comments and scripts are stepped over."""
    over = "" if name in PLAIN else r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|"
    return re.compile(rf"{over}(?P<end></{name}(?=[\s/>]|\Z)[^>]*>?)", re.S | re.I)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", text), ("open", tag) and ("close", name) in order, by one pass; comments and RAW elements are left out."""
    at, unclosed = 0, set()
    while at < len(page):
        left = page.find("<", at)
        if left < 0:
            yield "text", page[at:]
            return
        if left > at:
            yield "text", page[at:left]
        at = left
        if page.startswith("<!--", at):
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        elif not (found := NAME.match(page, at)):
            yield "text", "<"
            at += 1
        else:
            end, name = tag_end(page, at + len(found[0])), found[1].lower()
            if end < 0:
                return
            tag, at = page[at:end], end
            if tag[1] == "/":
                yield "close", name
            elif name not in RAW:
                yield "open", tag
            elif not tag.endswith("/>") and name not in unclosed:
                over = next((m for m in _raw_end(name).finditer(page, at) if m["end"]), None)
                if over:
                    at = over.end()
                elif name == "script":
                    return
                else:
                    unclosed.add(name)


@dataclass
class Element:
    parent: int
    features: tuple[str, ...]
    label: bool | None
    home: str = ""
    block: str = ""
    words: int = 0
    linked: int = 0
    links: int = 0
    titles: int = 0


@dataclass
class Block:
    words: int = 0
    linked: int = 0
    tags: int = 0
    last: str = ""


@dataclass
class Page:
    """Items (kind, text, element, block): kind "w" words, "t" tag inside the flow, "b" block edge."""

    items: list[tuple[str, str, int, int]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element(-1, (), None)])
    blocks: list[Block] = field(default_factory=lambda: [Block()])


def parsed(page: str) -> Page:
    """The work of an end tag is bounded by the elements that it closes."""
    out = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    run = 0

    def leave() -> None:
        opened[stack.pop()[0]] -= 1

    def edge(name: str) -> None:
        if name in BLOCKS:
            out.items.append(("b", name, stack[-1][1], len(out.blocks) - 1))
            if out.blocks[-1].words:
                out.blocks.append(Block())
        else:
            out.items.append(("t", name, stack[-1][1], len(out.blocks) - 1))

    for kind, value in tokens(page):
        if kind == "text":
            n, element, block = len(value.split()), out.elements[stack[-1][1]], out.blocks[-1]
            if n:
                if not block.words:
                    block.tags, run = run, 0
                linked = n if opened["a"] else 0
                element.words, element.linked = element.words + n, element.linked + linked
                block.words, block.linked, block.last = block.words + n, block.linked + linked, value.rstrip()[-1]
            out.items.append(("w", value, stack[-1][1], len(out.blocks) - 1))
            continue
        run += 1
        name = value if kind == "close" else NAME.match(value)[1].lower()
        if kind == "close":
            if opened[name]:
                while stack[-1][0] != name:
                    leave()
                leave()
            edge(name)
            continue
        if name in ENDS_P and stack[-1][0] == "p" or name == stack[-1][0] and name in ("li", "dt", "dd", "td", "th", "tr", "option", "a"):
            leave()
        elif name in ENDS_P and opened["p"]:  # a p that inline elements were left open in
            depth = next((i for i in range(len(stack) - 1, max(0, len(stack) - 9), -1) if stack[i][0] in BLOCKS), 0)
            if stack[depth][0] == "p":
                while len(stack) > depth:
                    leave()
        if name not in VOID:
            label = LABEL.search(value)
            above = out.elements[stack[-1][1]]
            home, block = (name, "") if name in SECTIONS else (above.home, name if name in BLOCKS - MUTE else above.block)
            out.elements.append(Element(stack[-1][1], features(value), None if label is None else not label[1], home, block, links=int(name == "a"), titles=int(name == "h1")))
            stack.append((name, len(out.elements) - 1))
            opened[name] += 1
        edge(name)
    for e in reversed(out.elements[1:]):
        above = out.elements[e.parent]
        above.words, above.linked, above.links = above.words + e.words, above.linked + e.linked, above.links + e.links
        above.titles += e.titles
        if e.titles and "header" in e.features:
            e.features += ("header with title",)
        if e.links >= MANY_LINKS and e.linked >= LINK_SHARE * e.words:
            e.features += ("list of links",)
    return out


def step(n: float, *bounds: float) -> int:
    return sum(n >= b for b in bounds)


SHAPES = ("size ", "links ", "tags ", "end ", "near ", "blocks ")


def shapes(page: Page) -> list[tuple[str, ...]]:
    """Of each block: its size, share of links, tags before it, how it ends, whether a long block is next to it, and
    whether the page has others at all."""
    many = step(len(page.blocks), 3, 7)
    long = [b.words >= 10 and 2 * b.linked < b.words for b in page.blocks]
    out = []
    for i, b in enumerate(page.blocks):
        near = (i > 0 and long[i - 1]) + (i + 1 < len(long) and long[i + 1])
        out.append((f"size {step(b.words, 4, 10, 25)}", f"links {step(b.linked / max(1, b.words), 0.34, 0.67)}", f"tags {step(b.tags, 3, 6)}", f"end {b.last in '.!?:;' if b.last else False}", f"near {near}", f"blocks {many}"))
    return out


def place(e: Element) -> str:
    """The section that an element stands in and its own kind of block."""
    return f"{e.block} in {e.home}"


@dataclass
class Weights:
    """Log-odds of features, of any word, and of a tag."""

    of: dict[str, float]
    bias: float
    tag: float


def examples(pages: list[str]) -> tuple[Counter, Counter, Counter, Counter]:
    """Weights of (features, is content) of the texts in labelled pages, each text counted by the root of its words;
    pages that have each feature; words and tags by label."""
    out, seen, words, tags = Counter(), Counter(), Counter(), Counter()
    for text in pages:
        page = parsed(text)
        shape = shapes(page)
        label, path = [False] * len(page.elements), [frozenset()] * len(page.elements)
        for i, e in enumerate(page.elements[1:], 1):
            label[i] = label[e.parent] if e.label is None else e.label
            path[i] = path[e.parent] | set(e.features)
        seen.update(set(map(place, page.elements)).union(*path, *shape))
        for kind, value, e, b in page.items:
            if kind != "w":
                tags[label[e]] += 1
            elif n := len(value.split()):
                words[label[e]] += n
                out[path[e] | {place(page.elements[e])} | set(shape[b]), label[e]] += math.sqrt(n)
    return out, seen, words, tags


def ascend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression beside fixed log-odds, by accelerated gradient steps."""
    theta, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, STEPS + 1):
        gradient = ((y - 1 / (1 + np.exp(-x @ theta - offset))) * weight) @ x - RIDGE * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return theta


def fit(pages: list[str]) -> Weights:
    """Logistic regression over the texts of labelled pages, first by what stands around a text, then by its shape for
    what that leaves open. A feature of fewer than LEAST_PAGES says nothing. A tag's log-odds are those of tags among
    tokens, inside content against elsewhere."""
    found, seen, words, tags = examples(pages)
    index = {x: i for i, x in enumerate(sorted((f for f, n in seen.items() if n >= LEAST_PAGES), key=lambda f: (f.startswith(SHAPES), f)))}
    kept: Counter = Counter()
    for (f, content), n in found.items():
        kept[tuple(sorted(index[k] for k in f if k in index)), content] += n
    x, y, weight = np.zeros((len(kept), len(index) + 1)), np.array([float(c) for _, c in kept]), np.array([*kept.values()])
    x[:, 0] = 1
    for row, (f, _) in enumerate(kept):
        x[row, np.array(f) + 1] = 1
    weight /= weight.sum()
    around = 1 + sum(not f.startswith(SHAPES) for f in index)
    theta = ascend(x[:, :around], y, weight, np.zeros(len(y)))
    theta = np.append(theta, ascend(x[:, around:], y, weight, x[:, :around] @ theta))
    share = {c: tags[c] / (tags[c] + words[c]) for c in (True, False)}
    return Weights({n: float(theta[i + 1]) for n, i in index.items() if abs(theta[i + 1]) >= LEAST_WEIGHT} | {"hidden": -math.inf}, float(theta[0]), math.log(share[True] / share[False]))


@lru_cache(1)
def learned() -> Weights:
    return fit(labelled_pages())


def scores(page: Page, weights: Weights) -> list[float]:
    """Log-odds of the words of each item. An element's features count once on their path."""
    known, sums, paths = weights.of, [weights.bias], [frozenset()]
    for e in page.elements[1:]:
        new = {f for f in e.features if f in known} - paths[e.parent]
        sums.append(sums[e.parent] + sum(known[f] for f in new))
        paths.append(paths[e.parent] | new if new else paths[e.parent])
    shape = [sum(known.get(f, 0.0) for f in x) for x in shapes(page)]
    places = [known.get(place(e), 0.0) for e in page.elements]
    return [sums[e] + places[e] + shape[b] for _, _, e, b in page.items]


def sequence(page: str, weights: Weights) -> list[tuple[str, str, float]]:
    """The words and tags of a page with their scores, without what is hardly ever content."""
    cut = parsed(page)
    low, high = WORD_RANGE
    cost = max(TAG_RANGE[0], min(TAG_RANGE[1], weights.tag))
    out = []
    for (kind, text, _, _), odds in zip(cut.items, scores(cut, weights), strict=True):
        if kind != "w":
            out.append((kind, text, cost))
        elif odds >= LEFT_OUT:
            out.append((kind, text, len(text.split()) * max(low, min(high, odds))))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of the greatest sum, by one scan."""
    best = now = 0.0
    start, region = 0, (0, 0)
    for i, value in enumerate(values):
        now += value
        if now <= 0:
            now, start = 0.0, i + 1
        elif now > best:
            best, region = now, (start, i + 1)
    return region


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best contiguous region, joined by an empty line."""
    items = sequence(page, weights)
    region = best_run([score for _, _, score in items])
    blocks, parts = [], []
    for kind, text, _ in items[slice(*region)]:
        if kind == "w":
            parts.append(text)
        elif kind == "b":
            blocks.append("".join(parts))
            parts = []
        elif text == "br":
            parts.append(" ")
    clean = (WHITE.sub(" ", html.unescape(x)).strip() for x in [*blocks, "".join(parts)])
    return "\n\n".join(x for x in clean if x)


def extract_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row. Null and empty pages give an empty text; broken markup is read to its
    end, but what follows the beginning of a tag that never ends is part of that tag; repeated rows stay; other columns
    are not read. One narrow map, no keys."""
    weights = learned() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(x, weights) for x in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
