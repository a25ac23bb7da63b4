"""Scalar functions as Column expressions; none runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHARS_PER_TOKEN, GAP_NAMES, GAP_TYPE, MAX_BODY, PAGE_MARK, PAPER_STATUS, READING_STATUS

# Section names that head a line of their own.
HEADINGS = (
    "abstract|introduction|background|related work|methods|method|materials and methods|results|results and discussion|"
    "discussion|conclusions?|references|acknowledg(?:e)?ments?"
)


#: White space of any script; the regular expressions' own sign for it is that of ASCII.
WHITE = r"\p{IsWhite_Space}"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def normalize_doi(c: Column) -> Column:
    return blank_to_null(F.lower(strip(F.regexp_replace(strip(c), r"^(https?://(dx\.)?doi\.org/|doi:)", ""))))


def normalize_title(c: Column) -> Column:
    words = F.regexp_replace(c, rf"[^\p{{IsAlphabetic}}\p{{N}}{WHITE}]", "")
    return F.lower(F.trim(F.regexp_replace(words, rf"{WHITE}+", " ")))


def work_id(c: Column) -> Column:
    return blank_to_null(F.substring_index(c, "/", -1))


def arxiv_id(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(c, "/", -1), "v[0-9]+$", "")


def split_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), strip), lambda x: x != "")


def comma_list(c: Column) -> Column:
    return F.transform(F.split(c, ","), strip)


def year_from_text(c: Column) -> Column:
    """Last four of the first maximal run of digits whose length is a multiple of four; zero is no year."""
    return F.nullif(F.regexp_extract(c, "(?<![0-9])(?:[0-9]{4})*([0-9]{4})(?![0-9])", 1).try_cast("int"), F.lit(0))


def intent_label(intents: Column, influential: Column) -> Column:
    more = F.when(influential, F.array(F.lit("influential"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(intents, more), "+")


def author_name(*parts: Column) -> Column:
    return F.concat_ws(" ", *[blank_to_null(strip(x)) for x in parts])


def one_of(c: Column, known: tuple[str, ...]) -> Column:
    return F.when(c.isin(*known), c).otherwise(known[0])


def paper_status(c: Column) -> Column:
    return one_of(c, PAPER_STATUS)


def reading_status(c: Column) -> Column:
    return one_of(c, READING_STATUS)


def gap_type(c: Column) -> Column:
    return one_of(c, GAP_TYPE)


def rating(c: Column) -> Column:
    return F.when(c.between(1, 5), c)


def provenance(arxiv: Column, s2: Column, pdf: Column) -> Column:
    return F.when(arxiv.isNotNull(), "arxiv").when(s2.isNotNull(), "semantic_scholar").when(pdf.isNotNull(), "pdf").otherwise("manual")


def source_link(url: Column, doi: Column, arxiv: Column, pdf: Column) -> Column:
    return F.coalesce(url, F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv), pdf)


def merge_tags(current: Column, added: Column) -> Column:
    """Union in order, trimmed, without blanks; the first spelling stays."""
    return F.array_distinct(F.filter(F.transform(F.concat(current, added), strip), lambda x: x != ""))


def prepare_body(c: Column) -> Column:
    lines = F.regexp_replace(c, "(?md)[ \\t\\r\\f\\x0B]+$", "")
    marked = F.regexp_replace(lines, rf"(?imd)^\s*({HEADINGS})\s*:?\s*$", "\n## $1\n")
    return F.when(strip(marked) != "", F.substring(marked, 1, MAX_BODY))


def anchor_section(before: Column) -> Column:
    return blank_to_null(strip(F.regexp_extract(F.concat(F.lit("\n"), before), "(?s).*\\n## ([^\\n]*)", 1)))


def anchor_page(before: Column) -> Column:
    return F.regexp_extract(F.concat(F.lit("\n"), before), f"(?s).*\\n{PAGE_MARK}([0-9]+)", 1).try_cast("int")


def place(section: Column, page: Column) -> Column:
    inside = F.concat_ws(", ", section, F.concat(F.lit("p."), page.cast("string")))
    return F.when(inside != "", F.concat(F.lit("("), inside, F.lit(")"))).otherwise("")


def join_pages(pages: Column) -> Column:
    one = lambda x, i: F.concat(F.lit(PAGE_MARK), (i + 1).cast("string"), F.lit(" -->\n"), x, F.when(x.endswith("\n"), "").otherwise("\n"))
    return F.array_join(F.transform(pages, one), "")


def abstract_rebuild(index: Column) -> Column:
    """Words of an inverted index (word -> positions) in order of position."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " ")


def abstract_from_body(c: Column) -> Column:
    """First 30 lines without page marks, as one line of at most 1000 characters."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.startswith(PAGE_MARK))
    return F.substring(F.trim(F.regexp_replace(F.array_join(F.slice(lines, 1, 30), "\n"), r"\s+", " ")), 1, 1000)


def report_sections(md: Column) -> Column:
    """Headed blocks of a report: array of (heading, content). Text before the first heading is dropped; a report
    without headings is one Overview without its title lines."""
    parts = F.split(F.concat(F.lit("\n"), md), "\n## ")
    one = lambda x: F.struct(strip(F.substring_index(x, "\n", 1)).alias("heading"), strip(F.when(x.contains("\n"), F.regexp_replace(x, "^[^\\n]*\\n", "")).otherwise("")).alias("content"))
    body = strip(F.array_join(F.filter(F.split(strip(md), "\n"), lambda x: ~x.startswith("# ")), "\n"))
    whole = F.array(F.struct(F.lit("Overview").alias("heading"), F.when(body == "", strip(md)).otherwise(body).alias("content")))
    return F.when(F.size(parts) > 1, F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)).when(strip(md) == "", F.array().cast("array<struct<heading:string,content:string>>")).otherwise(whole)


def sections_for_saving(md: Column) -> Column:
    """As ``report_sections``, but text before the first heading is a section without a heading, and contents keep their
    ends."""
    kind = "array<struct<heading:string,content:string>>"

    def more(found: Column, line: Column) -> Column:
        head = F.array(F.struct(strip(F.substring(line, 4, F.length(line))).alias("heading"), F.lit("").alias("content")))
        last = F.element_at(found, -1)
        grown = F.struct(last["heading"].alias("heading"), F.concat(last["content"], F.when(last["content"] != "", "\n").otherwise(""), line).alias("content"))
        rest = F.slice(found, F.lit(1), F.size(found) - 1)
        alone = F.when(strip(line) != "", F.array(F.struct(F.lit("").alias("heading"), line.alias("content")))).otherwise(F.array().cast(kind))
        return F.when(line.startswith("## "), F.concat(found, head)).when(F.size(found) > 0, F.concat(rest, F.array(grown))).otherwise(alone)

    return F.aggregate(F.split(F.regexp_replace(md, "\n$", ""), "\n"), F.array().cast(kind), more)


def report_markdown(title: Column, sections: Column) -> Column:
    body = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["content"], F.lit("\n\n"))), "")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body)


def gap_lines(reply: Column) -> Column:
    """Lines `Name|description` of a reply: array of (gap_type, description)."""
    names = F.create_map(*[F.lit(x) for pair in zip(GAP_NAMES, GAP_TYPE, strict=True) for x in pair])
    one = lambda line: F.struct(F.try_element_at(names, strip(F.substring_index(line, "|", 1))).alias("gap_type"), strip(F.regexp_replace(line, "^[^|]*\\|", "")).alias("description"))
    return F.filter(F.transform(F.filter(F.split(reply, "\n"), lambda x: x.contains("|")), one), lambda s: s["gap_type"].isNotNull())


def keyword_lines(reply: Column) -> Column:
    """Lines `paper id|keywords` of a reply: array of (paper_id, keywords)."""
    one = lambda line: F.struct(strip(F.substring_index(line, "|", 1)).alias("paper_id"), strip(F.regexp_replace(line, "^[^|]*\\|", "")).alias("keywords"))
    return F.filter(F.transform(F.filter(F.split(reply, "\n"), lambda x: x.contains("|")), one), lambda s: (s["paper_id"] != "") & (s["keywords"] != ""))


def percent_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "")


def tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / CHARS_PER_TOKEN)


def priority(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))
