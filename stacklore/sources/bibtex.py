"""BibTeX files. The only parser whose grammar needs a program: braces nest without limit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MONTHS = {m: m.capitalize() for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()}


def _value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field's value from ``at``: braced, quoted, number or name, joined by #."""
    out = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        if text[at] in '{"':
            close, depth, begin = ("}" if text[at] == "{" else '"'), 0, at + 1
            at += 1
            while at < len(text) and not (text[at] == close and depth == 0):
                depth += (text[at] == "{") - (text[at] == "}")
                at += 2 if text[at] == "\\" else 1
            out.append(text[begin:at])
            at += 1
        else:
            m = re.compile(r"[^\s,#}]+").match(text, at)
            if not m:
                break
            out.append(strings.get(m[0].lower(), m[0]))
            at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] != "#":
            break
        at += 1
    return "".join(out), at


def entries(text: str) -> list[dict[str, str]]:
    found, strings = [], dict(MONTHS)
    for m in re.finditer(r"@\s*(\w+)\s*[{(]", text):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        fields = {}
        if kind != "string":
            cut = re.compile(r"[^,}\s]*\s*,?").match(text, at)
            at = cut.end()
        while f := re.compile(r"\s*,?\s*([\w:+-]+)\s*=").match(text, at):
            value, at = _value(text, f.end(), strings)
            fields[f[1].lower()] = value
        if kind == "string":
            strings.update(fields)
        else:
            found.append(fields)
    return found


def clean(value: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", value.replace("\\&", "&").replace("\\%", "%").replace("\\_", "_").replace("~", " "))).strip()


def person(name: str) -> str:
    parts = [clean(x) for x in name.split(",")]
    if len(parts) == 1:
        return parts[0]
    return " ".join(x for x in ([parts[1], parts[0]] if len(parts) == 2 else [parts[2], parts[0], parts[1]]) if x)


def parse(documents: DataFrame) -> DataFrame:
    """Papers of files (file, content). Untitled entries go; a file that can't be read gives one row with its error."""
    names = ("title", "abstract_text", "date", "venue", "doi", "url", "keywords")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["file"], frame["content"], strict=True):
                try:
                    for e in entries(content or ""):
                        g = lambda *k, e=e: next((clean(e[x]) for x in k if e.get(x)), None)
                        authors = [person(x) for x in re.split(r"\s+and\s+", e.get("author", "")) if clean(x)]
                        rows.append((file, None, authors, g("title"), g("abstract"), g("year", "date"), g("journal", "journaltitle", "booktitle"), g("doi"), g("url"), g("keywords")))
                except Exception as error:
                    rows.append((file, str(error)[:300], [], *[None] * 7))
            yield pd.DataFrame(rows, columns=["file", "error", "authors", *names])

    kind = "file string, error string, authors array<string>, " + ", ".join(f"{n} string" for n in names)
    rows = documents.select("file", "content").mapInPandas(run, kind).where("error is not null or title != ''")
    year = T.year_from_text(F.regexp_extract("date", "^([^/]*)", 1))
    return rows.select("file", "error", "title", "authors", "abstract_text", year.alias("year"), "venue", T.normalize_doi(F.col("doi")).alias("doi"), "url", F.coalesce(T.split_keywords(F.col("keywords")), F.array().cast("array<string>")).alias("tags"))
