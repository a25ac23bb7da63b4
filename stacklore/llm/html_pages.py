"""Labelled pages from which the extraction weights are learned.

Whole pages of many layouts are written by rule, with invented text. An element with ``data-main`` holds content, one
with ``data-main="no"`` inside it doesn't. Half of all class names say nothing, so that what a page's shape tells is
learned as well as what its names tell; some names of content sound like those of boxes, as on real pages.
"""

from __future__ import annotations

import random

#: Boxes around the content: what they are called where their names say something, and the elements they stand in.
BOXES = {
    "menu": ("nav navbar menu main-nav site-nav navigation top-menu nav-links", "nav div ul"),
    "head": ("header site-header masthead page-header branding", "header div"),
    "foot": ("footer site-footer page-footer copyright bottom", "footer div"),
    "side": ("sidebar side-bar widget aside right-rail sidebar-widget", "aside div"),
    "ad": ("ad ads advert advertisement ad-box ad-slot sponsored banner promo", "div aside section"),
    "notice": ("notice cookie cookie-notice cookie-banner consent alert popup modal disclaimer", "div section dialog"),
    "letter": ("newsletter subscribe signup newsletter-form login search-form", "form div section"),
    "talk": ("comments comment-list reader-comments replies discussion post-comments", "section div ol"),
    "more": ("related related-posts recommended read-next more-stories", "section div aside"),
    "row": ("breadcrumb breadcrumbs share social share-buttons tag-list meta pager", "div ul nav"),
}
CONTENT = "content post article entry story text post-body entry-content article-body main-content".split()
#: Parts of content whose names sound like boxes.
ODD = "header-image search-results related-work menu-prices tags comment-policy share-capital ad-campaign notice-period".split()
CONTAINERS = ("article", "main", "main><article", "div", "div><div", "section", "section><div", "td", "")


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(["ka", "lo", "mi", "ter", "sun", "re", "da", "ven", "po", "is"], k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(n))

    def sentence(self, least: int = 1, most: int = 22) -> str:
        return self.words(self.r.randint(least, most)).capitalize() + self.r.choice(("", "", ".", ".", ".", ".", ".", "!", "?"))

    def text(self, most: int = 6) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(1, most))]
        if self.r.random() < 0.35:
            k = self.r.randrange(len(parts))
            tag = self.r.choice(("a href='/x'", "b", "em", "strong", "span", "code", "i"))
            parts[k] = f"<{tag}>{parts[k]}</{tag.split()[0]}>"
        return " ".join(parts)

    def named(self, tag: str, names: list[str] | str, telling: float = 0.5) -> str:
        kind = self.r.choice(("class", "class", "id"))
        name = self.r.choice(names.split() if isinstance(names, str) else names) if self.r.random() < telling else "x" + "".join(self.r.choices("bcdfgh0123456789", k=5))
        return tag if self.r.random() > 0.35 + telling else f'{tag} {kind}="{name}"'

    def links(self, n: int, most: int = 3) -> str:
        one = lambda: f"<a href='/{self.r.randrange(99)}'>{self.words(self.r.randint(1, most)).capitalize()}</a>"
        return "".join(f"<li>{one()}</li>" for _ in range(n)) if self.r.random() < 0.6 else self.r.choice((" ", " | ", " &middot; ")).join(one() for _ in range(n))

    def box(self, kind: str, telling: float = 0.5) -> str:
        names, tags = BOXES[kind]
        r, tag = self.r, self.r.choice(tags.split())
        inner = {
            "menu": lambda: self.links(r.randint(3, 9)),
            "row": lambda: self.links(r.randint(2, 5)),
            "head": lambda: f"<a href='/'>{self.words(2)}</a> <p>{self.sentence(2, 7)}</p>" + self.links(r.randint(0, 4)),
            "foot": lambda: f"<p>&copy; {self.words(r.randint(2, 9))}.</p>" + self.links(r.randint(0, 5)) if r.random() < 0.5 else f"&copy; {self.words(2)}.example &middot; {self.text(3)}",
            "side": lambda: f"<h3>{self.words(2)}</h3>" + (self.links(r.randint(3, 6), 6) if r.random() < 0.6 else f"<p>{self.text(2)}</p>"),
            "ad": lambda: self.sentence(3, 12) + (f" <a href='/b'>{self.words(2)}</a>" if r.random() < 0.6 else ""),
            "notice": lambda: f"<p>{self.sentence(5, 16)}</p><button>{self.words(1)}</button>",
            "letter": lambda: f"<p>{self.sentence(3, 12)}</p><label>{self.words(1)}</label><input><button>{self.words(1)}</button>",
            "talk": lambda: f"<h3>{self.words(1)}</h3>" + "".join(f"<div><a href='/u'>{self.words(1)}</a> <span>{self.words(2)}</span><p>{self.text(2)}</p></div>" for _ in range(r.randint(1, 5))),
            "more": lambda: f"<h3>{self.words(2)}</h3>" + self.links(r.randint(3, 6), 9),
        }[kind]()
        return f"<{self.named(tag, names, telling)}>{inner}</{tag}>"

    def block(self) -> str:
        r = self.r
        return r.choice(
            (
                lambda: f"<p>{self.text()}</p>", lambda: f"<p>{self.text()}</p>", lambda: f"<p>{self.text()}</p>", lambda: f"<p>{self.text(1)}", lambda: f"<p>{self.sentence(1, 2)}</p>", lambda: f"<h2>{self.words(r.randint(1, 6))}</h2><p>{self.text()}</p>",
                lambda: "<ul>" + "".join(f"<li>{self.text(2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", lambda: f"<ol><li><p>{self.text(2)}</p></li><li>{self.sentence()}</li></ol>", lambda: f"<blockquote><p>{self.text(3)}</p></blockquote>", lambda: f"<pre><code>{self.words(12)}</code></pre>",
                lambda: f"<table><tr><th>{self.words(1)}</th><td>{self.sentence(1, 8)}</td></tr><tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr></table>", lambda: f"<figure><img src='x'><figcaption>{self.sentence(2, 10)}</figcaption></figure>", lambda: f"<dl><dt>{self.words(1)}</dt><dd>{self.text(2)}</dd></dl>",
                lambda: f"<div>{self.text()}<br><br>{self.text()}</div>", lambda: f"{self.text()}<br>", lambda: f'<div class="{r.choice(ODD)}"><p>{self.text()}</p></div>', lambda: f"<section><h3>{self.words(2)}</h3><p>{self.text()}</p></section>",
            )
        )()

    def page(self) -> str:
        r, some = self.r, lambda *kinds: "".join(self.box(k) for k in kinds if self.r.random() < 0.6)
        title = f"<h1>{self.words(r.randint(1, 9)).capitalize()}</h1>"
        title = f"<header>{title}<p>{self.sentence(2, 8)}</p></header>" if r.random() < 0.2 else title
        body = [title] * (r.random() < 0.85) + [self.block() for _ in range(r.randint(1, r.choice((1, 1, 3, 9, 14))))] + [f"<p>{self.sentence(1, 3)}</p>"] * (r.random() < 0.3)
        for kind in ("ad", "ad", *BOXES):
            if r.random() < 0.15:  # such a box has to have a name, as nothing else tells it from a paragraph
                body.insert(r.randint(1, len(body)), self.box(kind, 1.0).replace(">", ' data-main="no">', 1))
        outer = r.choice(CONTAINERS)
        tags = outer.split("><") if outer else ["div"]
        begin = "".join(f"<{self.named(t, CONTENT) if outer else t}{' data-main' if k == len(tags) - 1 else ''}>" for k, t in enumerate(tags))
        content = begin + "".join(body) + "".join(f"</{t}>" for t in reversed(tags))
        if outer == "td":
            content = f"<table><tr><td>{self.links(4)}</td>{content}</tr></table>"
        if r.random() < 0.06:  # a bare fragment
            return content
        return f"<html><head><title>{self.words(5)}</title></head><body>{some('notice', 'head', 'menu', 'row', 'ad')}{content}{some('row', 'more', 'talk', 'side', 'ad', 'letter', 'foot', 'notice')}</body></html>"


def labelled_pages(n: int = 600) -> list[str]:
    """Whole pages, and bare texts, some of them deep."""
    bare = lambda k: f"{'<div>' * (k % 12)}<div data-main>{_Writer(-k).words(1 + k % 9)}</div>"
    lines = lambda k: f"<div data-main><p>{_Writer(-k).words(1 + k % 5)}<p>{_Writer(k).words(1 + k % 4)}</div>"
    return [_Writer(seed).page() for seed in range(n)] + [f(k) for k in range(1, 37) for f in (bare, lines)]
