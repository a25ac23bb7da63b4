"""Every query of the engine over the fixture library, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import export, graph, identity, scans, search, stats, topics
from ..postings import WordIndex
from ..scratch import Scratch
from .fixture_sql import doi, title, with_views
from .fixtures import Fixture

QUERY, TWO_TERMS, BODY_QUERY = "thst", "src1 thst", "there with"
ENTRIES: dict[str, tuple[Callable[[Fixture], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        ENTRIES[f.__name__] = (f, sql and with_views(sql))
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Fixture(spark, sf_dir)) for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}


# -- scalars ---------------------------------------------------------------------------------------------------------


_WIDE = "CASE seq % 4 WHEN 0 THEN 160 WHEN 1 THEN 8195 WHEN 2 THEN 9 ELSE 32 END"


def _wide(n) -> Column:
    """White space of several scripts by row."""
    return F.when(n % 4 == 0, "\u00a0").when(n % 4 == 1, "\u2003").when(n % 4 == 2, "\t").otherwise(" ")


@query(f"SELECT id, {doi(f'chr({_WIDE}) || doi || chr({_WIDE})')} AS doi_norm FROM papers")
def normalize_doi(x: Fixture) -> DataFrame:
    space = _wide(F.col("seq"))
    return x.papers().select("id", T.normalize_doi(F.concat(space, "doi", space)).alias("doi_norm"))


@query(f"""SELECT id, {title(f"replace(title, ' ', chr({_WIDE}))")} AS title_norm FROM papers""")
def normalize_title(x: Fixture) -> DataFrame:
    return x.papers().select("id", T.normalize_title(F.replace("title", F.lit(" "), _wide(F.col("seq")))).alias("title_norm"))


@query("SELECT id, nullif(regexp_extract(openalex_id, '([^/]*)$', 1), '') AS work FROM papers")
def work_id(x: Fixture) -> DataFrame:
    return x.papers().select("id", T.work_id(F.col("openalex_id")).alias("work"))


@query("SELECT id, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS arxiv FROM papers")
def arxiv_id(x: Fixture) -> DataFrame:
    return x.papers().select("id", T.arxiv_id(F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id")).alias("arxiv"))


@query(r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(keywords, '[,;]'), lambda k: trim(k)), lambda k: k <> ''), '|') AS kws FROM papers")
def split_keywords(x: Fixture) -> DataFrame:
    return x.papers().select("id", F.array_join(T.split_keywords(F.col("keywords")), "|").alias("kws"))


_DATES = "'published ' || CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey * 7 + 1900 AS VARCHAR) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 2 THEN '20130801' ELSE o_orderpriority || ' 0000 ' || o_orderkey END"


@query(f"SELECT o_orderkey, nullif(TRY_CAST(nullif(regexp_extract({_DATES}, '(?:^|[^0-9])(?:[0-9]{{4}})*([0-9]{{4}})(?:[^0-9]|$)', 1), '') AS INTEGER), 0) AS year FROM orders")
def year_from_text(x: Fixture) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("published "), F.when(k % 4 == 0, (k * 7 + 1900).cast("string")).when(k % 4 == 1, F.col("o_orderdate").cast("date").cast("string")).when(k % 4 == 2, "20130801").otherwise(F.concat("o_orderpriority", F.lit(" 0000 "), k)))
    return x.table("orders").select("o_orderkey", T.year_from_text(text).alias("year"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || '+' || l_linestatus || CASE WHEN l_quantity > 25 THEN '+influential' ELSE '' END AS label FROM lineitem")
def intent_label(x: Fixture) -> DataFrame:
    return x.table("lineitem").select("l_orderkey", "l_linenumber", T.intent_label(F.array("l_returnflag", "l_linestatus"), F.col("l_quantity") > 25).alias("label"))


@query("SELECT c_custkey, concat_ws(' ', nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment || ' ' END), ''), CASE WHEN c_custkey % 2 = 0 THEN 'von' END, nullif(trim(c_name), '')) AS author FROM customer")
def author_names(x: Fixture) -> DataFrame:
    given = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit(" ")))
    return x.table("customer").select("c_custkey", T.author_name(given, F.when(F.col("c_custkey") % 2 == 0, "von"), F.col("c_name")).alias("author"))


@query("SELECT event_id, CASE WHEN event_type IN ('discovered', 'abstract_read', 'skimmed', 'read', 'deep_read') THEN event_type ELSE 'discovered' END AS status, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'abandoned' ELSE 'unread' END AS reading, CASE event_id % 5 WHEN 0 THEN 'connection_gap' WHEN 1 THEN 'methodology_gap' WHEN 2 THEN 'unanswered_question' ELSE 'missing_literature' END AS gap FROM events")
def enum_decode(x: Fixture) -> DataFrame:
    n = F.col("event_id")
    reading = F.when(n % 7 == 0, "queued").when(n % 7 == 1, "in_progress").when(n % 7 == 2, "completed").when(n % 7 == 3, "abandoned").otherwise("?")
    gap = F.when(n % 5 == 0, "connection_gap").when(n % 5 == 1, "methodology_gap").when(n % 5 == 2, "unanswered_question").otherwise("other")
    return x.table("events").select("event_id", T.paper_status(F.col("event_type")).alias("status"), T.reading_status(reading).alias("reading"), T.gap_type(gap).alias("gap"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber + CAST(l_quantity AS INTEGER) % 6 BETWEEN 1 AND 5 THEN l_linenumber + CAST(l_quantity AS INTEGER) % 6 END AS rating FROM lineitem")
def rating_decode(x: Fixture) -> DataFrame:
    return x.table("lineitem").select("l_orderkey", "l_linenumber", T.rating(F.col("l_linenumber") + F.col("l_quantity").cast("int") % 6).alias("rating"))


@query("SELECT id, CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv' WHEN s2_id IS NOT NULL THEN 'semantic_scholar' WHEN pdf_path IS NOT NULL THEN 'pdf' ELSE 'manual' END AS origin FROM papers")
def provenance(x: Fixture) -> DataFrame:
    return x.papers().select("id", T.provenance(F.col("arxiv_id"), F.col("s2_id"), F.col("pdf_path")).alias("origin"))


@query("SELECT id, coalesce(url, 'https://doi.org/' || doi, 'https://arxiv.org/abs/' || arxiv_id, pdf_path) AS link FROM papers")
def source_link(x: Fixture) -> DataFrame:
    return x.papers().select("id", T.source_link(F.col("url"), F.col("doi"), F.col("arxiv_id"), F.col("pdf_path")).alias("link"))


@query("SELECT id, array_to_string(list_filter(l, lambda t, i: list_position(l, t) = i), '|') AS merged FROM (SELECT id, list_filter(list_transform([' ' || lang, '', 'src1', lang, source], lambda t: trim(t)), lambda t: t <> '') AS l FROM papers)")
def merge_tags(x: Fixture) -> DataFrame:
    tags = T.merge_tags(F.array(F.concat(F.lit(" "), F.col("tags")[0]), F.lit(""), F.lit("src1")), F.col("tags"))
    return x.papers().select("id", F.array_join(tags, "|").alias("merged"))


_HEADINGS = T.HEADINGS
_BODY = "'Abstract:' || chr(10) || text || '  ' || chr(10) || ' RESULTS ' || chr(10) || 'results differ' || chr(10)"


@query(f"SELECT doc_id, md5(substring(regexp_replace(regexp_replace({_BODY}, '(?m)[ \\t\\r\\f\\v]+$', '', 'g'), '(?mi)^\\s*({_HEADINGS})\\s*:?\\s*$', chr(10) || '## \\1' || chr(10), 'g'), 1, 500000)) AS body FROM documents")
def prepare_body(x: Fixture) -> DataFrame:
    body = F.concat(F.lit("Abstract:\n"), "text", F.lit("  \n RESULTS \nresults differ\n"))
    return x.table("documents").select("doc_id", F.md5(T.prepare_body(body)).alias("body"))


@query(r"SELECT paper_id, substring(trim(regexp_replace(array_to_string(list_filter(string_split(body, chr(10)), lambda l: NOT starts_with(l, '<!-- page '))[1:30], chr(10)), '\s+', ' ', 'g')), 1, 1000) AS abstract FROM bodies")
def abstract_from_body(x: Fixture) -> DataFrame:
    return x.bodies().select("paper_id", T.abstract_from_body(F.col("body")).alias("abstract"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS abstract FROM lineitem GROUP BY l_orderkey")
def abstract_rebuild(x: Fixture) -> DataFrame:
    word = F.concat("l_returnflag", "l_linestatus")
    index = x.table("lineitem").groupBy("l_orderkey", word.alias("w")).agg(F.collect_list("l_linenumber").alias("p")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("index"))
    return index.select("l_orderkey", T.abstract_rebuild(F.col("index")).alias("abstract"))


_BEFORE = "substring(body, 1, length(body) // 2)"


@query(rf"SELECT paper_id, nullif(trim(regexp_extract(chr(10) || {_BEFORE}, '(?s).*\n## ([^\n]*)', 1)), '') AS section FROM bodies")
def anchor_section(x: Fixture) -> DataFrame:
    return x.bodies().select("paper_id", T.anchor_section(F.expr("substring(body, 1, length(body) div 2)")).alias("section"))


@query(rf"SELECT paper_id, TRY_CAST(nullif(regexp_extract(chr(10) || {_BEFORE}, '(?s).*\n<!-- page ([0-9]+)', 1), '') AS INTEGER) AS page FROM bodies")
def anchor_page(x: Fixture) -> DataFrame:
    return x.bodies().select("paper_id", T.anchor_page(F.expr("substring(body, 1, length(body) div 2)")).alias("page"))


@query("SELECT conv_id, md5(string_agg('<!-- page ' || n || ' -->' || chr(10) || text || CASE WHEN suffix(text, chr(10)) THEN '' ELSE chr(10) END, '' ORDER BY n)) AS body FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def join_pages(x: Fixture) -> DataFrame:
    pages = x.table("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("pages"))
    return pages.select("conv_id", F.md5(T.join_pages(F.col("pages"))).alias("body"))


_TRIMMED = r"'^\s+|\s+$', '', 'g'"
_SECTIONS = (
    "CASE WHEN contains(chr(10) || content, chr(10) || '## ') THEN list_transform(string_split(chr(10) || content, chr(10) || '## ')[2:], "
    "lambda x: {'h': trim(split_part(x, chr(10), 1)), 'c': regexp_replace(substring(x, length(split_part(x, chr(10), 1)) + 2), " + _TRIMMED + ")}) "
    "ELSE [{'h': 'Overview', 'c': regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT starts_with(l, '# ')), chr(10)), " + _TRIMMED + ")}] END"
)


@query(f"SELECT id, array_to_string(list_transform({_SECTIONS}, lambda s: s.h || '=' || s.c), '|') AS sections FROM reports")
def report_sections(x: Fixture) -> DataFrame:
    s = T.report_sections(F.col("content"))
    return x.reports().select("id", F.array_join(F.transform(s, lambda r: F.concat(r["heading"], F.lit("="), r["content"])), "|").alias("sections"))


@query(f"SELECT id, '# ' || title || chr(10) || chr(10) || array_to_string(list_transform({_SECTIONS}, lambda s: '## ' || s.h || chr(10) || chr(10) || s.c || chr(10) || chr(10)), '') AS md FROM reports")
def report_markdown(x: Fixture) -> DataFrame:
    return x.reports().select("id", T.report_markdown(F.col("title"), T.report_sections(F.col("content"))).alias("md"))


@query("SELECT 'rep' || r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN '=# T' || chr(10) || chr(10) || 'plain 0' ELSE '=# ' || r_name || chr(10) || 'lead|Scope=All of ' || r_name || chr(10) || 'and more' || chr(10) || '|Open questions=Number ' || r_regionkey END AS sections FROM region")
def report_save_sections(x: Fixture) -> DataFrame:
    s = T.sections_for_saving(F.col("content"))
    return x.reports().select("id", F.array_join(F.transform(s, lambda r: F.concat(r["heading"], F.lit("="), r["content"])), "|").alias("sections"))


def _lines(key: str, reply: str, source: str) -> str:
    """Lines of a reply that have a bar: key, head before it, rest after it."""
    lines = f"SELECT {key}, unnest(string_split({reply}, chr(10))) AS line FROM {source}"
    return rf"(SELECT {key}, trim(split_part(line, '|', 1)) AS head, trim(regexp_replace(line, '^[^|]*\|', '')) AS rest FROM ({lines}) WHERE contains(line, '|'))"


_NAMES = "CASE o_orderkey % 4 WHEN 0 THEN 'MissingLiterature' WHEN 1 THEN ' ConnectionGap ' WHEN 2 THEN 'Nothing' ELSE 'MethodologyGap' END"
_GAPS = _lines("o_orderkey", f"'Here you are' || chr(10) || {_NAMES} || '| ' || o_orderpriority || '|' || o_orderstatus || ' ' || chr(10)", "orders")
_WORDS = _lines("doc_id", "'Sure:' || chr(10) || ' p' || doc_id || ' | ' || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang || '; ' || source END || chr(10) || '|none' || chr(10)", "documents")


@query(f"SELECT * FROM (SELECT o_orderkey, CASE head WHEN 'MissingLiterature' THEN 'missing_literature' WHEN 'UnansweredQuestion' THEN 'unanswered_question' WHEN 'MethodologyGap' THEN 'methodology_gap' WHEN 'ConnectionGap' THEN 'connection_gap' END AS gap_type, rest AS description FROM {_GAPS}) WHERE gap_type IS NOT NULL")
def parse_gap_lines(x: Fixture) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "MissingLiterature").when(k % 4 == 1, " ConnectionGap ").when(k % 4 == 2, "Nothing").otherwise("MethodologyGap")
    reply = F.concat(F.lit("Here you are\n"), name, F.lit("| "), "o_orderpriority", F.lit("|"), "o_orderstatus", F.lit(" \n"))
    return x.table("orders").select("o_orderkey", F.inline(T.gap_lines(reply)))


@query(f"SELECT doc_id, head AS paper_id, rest AS keywords FROM {_WORDS} WHERE head <> '' AND rest <> ''")
def parse_keyword_lines(x: Fixture) -> DataFrame:
    n = F.col("doc_id")
    reply = F.concat(F.lit("Sure:\n p"), n, F.lit(" | "), F.when(n % 5 == 0, " ").otherwise(F.concat_ws("; ", "lang", "source")), F.lit("\n|none\n"))
    return x.table("documents").select("doc_id", F.inline(T.keyword_lines(reply)))


@query("SELECT id, regexp_replace(title, '[^A-Za-z0-9._-]', '', 'g') AS name, replace(url_encode(title), '%20', '+') AS encoded FROM papers")
def safe_names(x: Fixture) -> DataFrame:
    return x.papers().select("id", T.safe_filename(F.col("title")).alias("name"), T.percent_encode(F.col("title")).alias("encoded"))


# -- listings and queues ---------------------------------------------------------------------------------------------


@query("SELECT id, title, year, status, created_at FROM papers ORDER BY created_at DESC, id LIMIT 200")
def list_papers(x: Fixture) -> DataFrame:
    return scans.list_papers(x.papers(), 200).select("id", "title", "year", "status", "created_at")


@query("SELECT id, title, doi, venue FROM papers WHERE id = 'p42'")
def get_paper(x: Fixture) -> DataFrame:
    return scans.get(x.papers(), "id", "p42").select("id", "title", "doi", "venue")


@query("SELECT paper_id, body FROM bodies WHERE paper_id = 'p3'")
def paper_body(x: Fixture) -> DataFrame:
    return scans.get(x.bodies(), "paper_id", "p3")


@query("SELECT 'p' || doc_id AS paper_id, md5(substring(text, 1, 40000)) AS head, length(text) > 40000 AS truncated FROM documents")
def paper_body_capped(x: Fixture) -> DataFrame:
    return scans.body_capped(x.long_bodies()).select("paper_id", F.md5("body").alias("head"), "truncated")


@query("SELECT id, name, parent_topic_id, depth, priority FROM topics")
def topics_list(x: Fixture) -> DataFrame:
    return scans.list_topics(x.topics())


@query("SELECT id, name, depth FROM topics WHERE id = 'n7'")
def get_topic(x: Fixture) -> DataFrame:
    return scans.get(x.topics(), "id", "n7").select("id", "name", "depth")


@query("SELECT * FROM gaps")
def list_gaps(x: Fixture) -> DataFrame:
    return scans.list_gaps(x.gaps())


@query("SELECT * FROM gaps WHERE topic_id = 'n3'")
def list_gaps_by_topic(x: Fixture) -> DataFrame:
    return scans.list_gaps(x.gaps(), "n3")


@query("SELECT id, title, generated_at, CASE WHEN id = 'rep0' THEN 1 ELSE 2 END AS n_sections FROM reports ORDER BY generated_at DESC, id LIMIT 3")
def list_reports(x: Fixture) -> DataFrame:
    return scans.list_reports(x.reports(), 3).select("id", "title", "generated_at", F.size("sections").alias("n_sections"))


@query("SELECT topic_id, papers_read, papers_queued, coverage_score FROM state WHERE topic_id = 'n4'")
def get_research_state(x: Fixture) -> DataFrame:
    return scans.get(x.state(), "topic_id", "n4").select("topic_id", "papers_read", "papers_queued", "coverage_score")


@query("SELECT id, created_at FROM papers WHERE keywords = '' ORDER BY created_at DESC, id LIMIT 100")
def missing_keywords(x: Fixture) -> DataFrame:
    return scans.missing_keywords(x.papers(), 100).select("id", "created_at")


@query("SELECT p.id, relevance FROM papers p JOIN topic_papers t ON t.paper_id = p.id WHERE topic_id = 'n6' AND keywords = '' ORDER BY relevance DESC, created_at DESC, p.id LIMIT 10")
def missing_keywords_by_topic(x: Fixture) -> DataFrame:
    return scans.missing_keywords_by_topic(x.papers(), x.topic_papers(), "n6", 10).select("id", "relevance")


@query("SELECT p.id, p.title, relevance FROM papers p JOIN topic_papers t ON t.paper_id = p.id WHERE topic_id = 'n8' ORDER BY relevance DESC, created_at DESC, p.id LIMIT 25")
def papers_by_topic(x: Fixture) -> DataFrame:
    return scans.papers_by_topic(x.papers(), x.topic_papers(), "n8", 25).select("id", "title", "relevance")


@query("SELECT id, updated_at FROM papers ORDER BY updated_at, id LIMIT 50")
def stalest(x: Fixture) -> DataFrame:
    return scans.stalest(x.papers(), 50).select("id", "updated_at")


@query("SELECT p.id, updated_at FROM papers p JOIN topic_papers t ON t.paper_id = p.id WHERE topic_id = 'n2' ORDER BY updated_at, p.id LIMIT 10")
def stalest_by_topic(x: Fixture) -> DataFrame:
    return scans.stalest_by_topic(x.papers(), x.topic_papers(), "n2", 10).select("id", "updated_at")


@query("SELECT id, arxiv_id FROM papers WHERE arxiv_id IS NOT NULL AND id NOT IN (SELECT paper_id FROM bodies)")
def bodies_missing(x: Fixture) -> DataFrame:
    return scans.bodies_missing(x.papers(), x.bodies()).select("id", "arxiv_id")


@query("SELECT p.id, CASE WHEN pdf_path IS NULL THEN CASE WHEN arxiv_id IS NOT NULL THEN 'download' ELSE 'none' END WHEN coalesce(contains(body, '<!-- page '), false) THEN 'skip' ELSE 'extract' END AS action FROM papers p LEFT JOIN bodies b ON b.paper_id = p.id")
def reingest_worklist(x: Fixture) -> DataFrame:
    return scans.reingest_worklist(x.papers(), x.bodies())


# -- search ----------------------------------------------------------------------------------------------------------


def _bm25(terms: list[str], fields: dict[str, str], source: str, key: str, k: int, where: str = "") -> str:
    count = lambda t: " + ".join(f"(length({f}) - length(replace({f}, '{t}', ''))) // {len(t)}" for f in fields)
    low = ", ".join(f"lower({e}) AS {f}" for f, e in fields.items())
    size = " + ".join(f"greatest(length({f}) - 2, 0)" for f in fields)
    f = ", ".join(f"{count(t)} AS f{i}" for i, t in enumerate(terms))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(terms)))
    hit = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"WITH low AS (SELECT {key} AS id, {low} FROM {source}), tf AS (SELECT id, {size} AS size, {f} FROM low), st AS (SELECT count(*) AS n, avg(size) AS mean, {d} FROM tf), hits AS (SELECT id, -({score}) AS rank FROM tf, st WHERE {hit} {where})"


_META = {"f_title": "title", "f_abstract": "abstract_text", "f_notes": "notes", "f_tags": "'[\"' || lang || '\",\"' || source || '\"]'", "f_keywords": "keywords"}


@query(_bm25([QUERY], _META, "papers", "id", 20) + " SELECT id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, id LIMIT 20")
def search_papers(x: Fixture) -> DataFrame:
    return search.top(x.papers(), QUERY, 20).select("id", F.round("rank", 6).alias("rank"))


@query(_bm25(TWO_TERMS.split(), _META, "papers", "id", 20) + " SELECT id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, id LIMIT 20")
def search_two_terms(x: Fixture) -> DataFrame:
    return search.top(x.papers(), f'"{TWO_TERMS.split()[0]}" {TWO_TERMS.split()[1].upper()} a', 20).select("id", F.round("rank", 6).alias("rank"))


@query(_bm25(BODY_QUERY.split(), {"f_body": "body"}, "bodies", "paper_id", 20) + " SELECT id AS paper_id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, id LIMIT 20")
def search_bodies(x: Fixture) -> DataFrame:
    return search.top(x.bodies(), BODY_QUERY, 20, "paper_id", ("body",)).select("paper_id", F.round("rank", 6).alias("rank"))


_TIER = _bm25([QUERY], _META, "papers", "id", 20)
_DEEP = _bm25([QUERY], {"f_body": "body"}, "(SELECT 'p' || doc_id AS paper_id, text AS body FROM documents)", "paper_id", 20).replace("low", "blow").replace(" tf", " btf").replace(" st ", " bst ").replace(", st", ", bst").replace("hits", "bhits").replace("bblow", "blow").replace("blower", "lower")


@query(f"{_TIER}, {_DEEP.removeprefix('WITH ')}, meta AS (SELECT id, 0 AS tier, rank FROM hits ORDER BY rank, id LIMIT 20), deep AS (SELECT id, 1 AS tier, rank FROM bhits WHERE id NOT IN (SELECT id FROM meta) ORDER BY rank, id LIMIT 20) SELECT id, tier, round(rank, 6) AS rank FROM (SELECT * FROM meta UNION ALL SELECT * FROM deep) u ORDER BY tier, u.rank, id LIMIT 20")
def search_papers_merged(x: Fixture) -> DataFrame:
    return search.search_merged(x.papers(), x.long_bodies(), QUERY, 20).select("id", "tier", F.round("rank", 6).alias("rank"))


def _evidence(k: int) -> str:
    """Windows of the best bodies by trying every match as a beginning."""
    first, second = BODY_QUERY.split()
    head = "substring(body, 1, pos)"
    return rf"""{_bm25([first, second], {"f_body": "body"}, "bodies", "paper_id", k)},
 best AS (SELECT hits.id, hits.rank, p.title, b.body FROM hits JOIN papers p ON p.id = hits.id JOIN bodies b ON b.paper_id = hits.id ORDER BY hits.rank, hits.id LIMIT {k}),
 places AS (SELECT id, unnest(range(0, length(body))) AS pos, lower(body) AS low FROM best),
 m AS (SELECT id, pos, pos + length(w) AS stop, w FROM places, (VALUES ('{first}'), ('{second}')) t(w) WHERE substring(low, pos + 1, length(w)) = w),
 tried AS (SELECT a.id, a.pos, count(DISTINCT b.w) AS kinds, count(*) AS n, max(b.stop) AS stop FROM (SELECT DISTINCT id, pos FROM m) a JOIN m b ON b.id = a.id AND b.pos >= a.pos AND b.stop <= a.pos + 34 GROUP BY a.id, a.pos),
 one AS (SELECT id, pos, stop FROM tried QUALIFY row_number() OVER (PARTITION BY id ORDER BY kinds DESC, n DESC, pos) = 1),
 lead AS (SELECT o.id, o.pos, o.pos - least(8, o.pos, 34 + o.pos - o.stop, o.pos - coalesce((SELECT max(m.pos) FROM m WHERE m.id = o.id AND m.pos < o.pos), -1) - 1) AS start FROM one o)
 SELECT b.id AS paper_id, b.title, CASE WHEN start > 0 THEN '…' ELSE '' END || regexp_replace(substring(body, start + 1, 34), '(?i)({first}|{second})', '[\1]', 'g') || CASE WHEN start + 34 < length(body) THEN '…' ELSE '' END AS snippet,
 nullif(trim(regexp_extract(chr(10) || {head}, '(?s).*\n## ([^\n]*)', 1)), '') AS section, TRY_CAST(nullif(regexp_extract(chr(10) || {head}, '(?s).*\n<!-- page ([0-9]+)', 1), '') AS INTEGER) AS page, round(b.rank, 6) AS rank FROM best b JOIN lead USING (id)"""


@query(_evidence(10))
def body_evidence(x: Fixture) -> DataFrame:
    return search.evidence(x.papers(), x.bodies(), BODY_QUERY, 10)


def _indexed(x: Fixture, rows: DataFrame, fields: tuple[str, ...], text: str, changed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best rows by a word index; with ``changed`` one of the rows before, followed by a segment of the change."""
    scratch = Scratch(x.spark)
    scratch.names.add("index")
    index = WordIndex(x.spark, f"{scratch.root}/index", fields)
    if changed is None:
        index.build(rows, 1)
    else:
        former = changed(rows)
        index.build(former, 1)
        index.add(rows.where(~F.col("id").endswith("1")), former.where(~F.col("id").endswith("1")), former.select("id").where(~F.col("id").endswith("1")), 2)
    found = index.top(text, 20).select("id", F.round("rank", 6).alias("rank"))
    scratch.drop("index")
    return found


@query(_bm25(TWO_TERMS.split(), _META, "papers", "id", 20) + " SELECT id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, id LIMIT 20")
def indexed_search(x: Fixture) -> DataFrame:
    return _indexed(x, x.papers(), search.FIELDS, TWO_TERMS)


@query(_bm25([QUERY], {"f_body": "body"}, "(SELECT 'p' || doc_id AS paper_id, text AS body FROM documents)", "paper_id", 20) + " SELECT id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, id LIMIT 20")
def indexed_search_after_changes(x: Fixture) -> DataFrame:
    """Most bodies were others when the index was built, and come to it as a change."""
    rows = x.long_bodies().withColumnRenamed("paper_id", "id")
    return _indexed(x, rows, ("body",), QUERY, lambda r: r.withColumn("body", F.when(F.col("id").endswith("1"), F.col("body")).otherwise(F.concat(F.lit("thst before "), "body"))))


# -- identity and graph ----------------------------------------------------------------------------------------------

_RESOLVE = f"""lib AS (SELECT id, seq, {doi("doi")} AS kd, pdf_path AS kp, nullif({title("title")}, '') AS kt FROM papers),
 d AS (SELECT kd, arg_min(id, seq) AS m FROM lib WHERE kd IS NOT NULL GROUP BY kd), p AS (SELECT kp, arg_min(id, seq) AS m FROM lib WHERE kp IS NOT NULL GROUP BY kp), t AS (SELECT kt, arg_min(id, seq) AS m FROM lib WHERE kt IS NOT NULL GROUP BY kt),
 res AS (SELECT i.id, coalesce(d.m, p.m, t.m) AS matched_id, CASE WHEN d.m IS NOT NULL THEN 'doi' WHEN p.m IS NOT NULL THEN 'path' WHEN t.m IS NOT NULL THEN 'title' END AS matched_by
 FROM incoming i LEFT JOIN d ON d.kd = {doi("i.doi")} LEFT JOIN p ON p.kp = i.pdf_path LEFT JOIN t ON i.doi IS NULL AND i.pdf_path IS NULL AND t.kt = {title("i.title")})"""


@query(f"WITH {_RESOLVE} SELECT id, matched_id, matched_by FROM res")
def identity_resolve(x: Fixture) -> DataFrame:
    return identity.resolve(x.incoming(), x.papers()).select("id", "matched_id", "matched_by")


_FIRST_IMPORT = f"""WITH i AS (SELECT id, seq, {doi("doi")} AS k, pdf_path AS p, nullif({title("title")}, '') AS t, doi IS NULL AND pdf_path IS NULL AS asks FROM incoming),
 r AS (SELECT *, arg_min(id, seq) OVER (PARTITION BY k) AS head FROM i),
 fixed AS (SELECT id, seq, t FROM r WHERE k IS NOT NULL AND head = id OR k IS NULL AND p IS NOT NULL),
 m AS (SELECT t, arg_min(id, seq) AS id, min(seq) AS seq FROM (SELECT * FROM fixed UNION ALL SELECT id, seq, t FROM r WHERE asks) u WHERE t IS NOT NULL GROUP BY t),
 res AS (SELECT r.id, CASE WHEN k IS NOT NULL AND head <> r.id THEN head WHEN asks AND m.seq < r.seq THEN m.id END AS matched_id, CASE WHEN k IS NOT NULL AND head <> r.id THEN 'doi' WHEN asks AND m.seq < r.seq THEN 'title' END AS matched_by FROM r LEFT JOIN m ON m.t = r.t)
 SELECT id, matched_id, matched_by, matched_id IS NULL AS is_new FROM res"""


@query(_FIRST_IMPORT)
def identity_batch(x: Fixture) -> DataFrame:
    """A first import: the library is empty, so rows match each other only. Paths are all different here."""
    return identity.resolve_batch(x.incoming(), x.papers().where("false")).select("id", "matched_id", "matched_by", "is_new")


@query(f"WITH {_RESOLVE} SELECT CASE WHEN id LIKE 'b%' THEN 'benchmark' ELSE 'documents' END AS source, count(*) FILTER (matched_id IS NULL) AS added, count(*) FILTER (matched_id IS NOT NULL) AS in_library FROM res GROUP BY 1")
def ingest_summary(x: Fixture) -> DataFrame:
    rows = identity.resolve(x.incoming(), x.papers()).withColumn("source", F.when(F.col("id").startswith("b"), "benchmark").otherwise("documents"))
    return stats.ingest_summary(rows, "source")


@query(f"WITH lib AS (SELECT id, seq, nullif(regexp_extract(openalex_id, '([^/]*)$', 1), '') AS kw, {doi('doi')} AS kd FROM papers), w AS (SELECT kw, arg_min(id, seq) AS m FROM lib WHERE kw IS NOT NULL GROUP BY kw), d AS (SELECT kd, arg_min(id, seq) AS m FROM lib WHERE kd IS NOT NULL GROUP BY kd), rel AS (SELECT 'p' || l_orderkey AS source_id, 'https://openalex.org/W' || l_partkey AS wid, 'doi:10.1/x' || l_suppkey AS doi, l_linenumber AS line FROM lineitem) SELECT r.source_id, r.line, coalesce(w.m, d.m) AS paper_id FROM rel r LEFT JOIN w ON w.kw = regexp_extract(r.wid, '([^/]*)$', 1) LEFT JOIN d ON d.kd = {doi('r.doi')} WHERE coalesce(w.m, d.m) IS NOT NULL AND coalesce(w.m, d.m) <> r.source_id")
def link_related(x: Fixture) -> DataFrame:
    rel = x.table("lineitem").select(F.concat(F.lit("p"), "l_orderkey").alias("source_id"), F.concat(F.lit("https://openalex.org/W"), "l_partkey").alias("openalex_id"), F.concat(F.lit("doi:10.1/x"), "l_suppkey").alias("doi"), F.col("l_linenumber").alias("line"))
    return identity.link_related(rel, x.papers()).select("source_id", "line", "paper_id")


@query("SELECT citing, cited, context, seq FROM citations WHERE order_key % 2 = 1")
def citation_upsert(x: Fixture) -> DataFrame:
    c = x.citations()
    return graph.new_edges(c.where("order_key % 2 = 0").drop("order_key"), c.drop("order_key"))


@query("SELECT citing, cited, CASE WHEN seq = 1 AND order_key % 3 = 0 THEN 'relabelled' ELSE context END AS context, seq = 1 AND order_key % 3 = 0 AS changed FROM citations")
def citation_labels(x: Fixture) -> DataFrame:
    labels = x.citations().where("seq = 1 and order_key % 3 = 0").select("citing", "cited", F.lit("relabelled").alias("context"))
    ghosts = labels.select(F.concat(F.lit("q"), "citing").alias("citing"), "cited", "context")
    return graph.label_edges(x.citations().drop("order_key"), labels.unionByName(ghosts)).select("citing", "cited", "context", "changed")


@query("SELECT count(*) AS edges, count(*) FILTER (context <> '') AS labelled, count(*) FILTER (context = '') AS unlabelled FROM citations")
def edge_label_counts(x: Fixture) -> DataFrame:
    return graph.label_counts(x.citations())


@query("SELECT c.citing AS paper_id, c.cited AS other_id, coalesce(p.title, '(paper not in library)') AS title, c.context, c.seq FROM citations c LEFT JOIN papers p ON p.id = c.cited WHERE c.citing IN (SELECT id FROM papers WHERE year = 2003)")
def references_listing(x: Fixture) -> DataFrame:
    return graph.listing(x.citations(), x.papers(), x.papers().where("year = 2003"))


@query("SELECT c.cited AS paper_id, c.citing AS other_id, coalesce(p.title, '(paper not in library)') AS title, c.context, c.seq FROM citations c LEFT JOIN papers p ON p.id = c.citing WHERE c.cited IN (SELECT id FROM papers WHERE year = 2004)")
def cited_by_listing(x: Fixture) -> DataFrame:
    return graph.listing(x.citations(), x.papers(), x.papers().where("year = 2004"), cited_by=True)


@query(f"WITH named AS (SELECT DISTINCT 'p' || l_orderkey AS citing, arg AS cited FROM lineitem JOIN (SELECT {doi('doi')} AS k, arg_min(id, seq) AS arg FROM papers WHERE {doi('doi')} IS NOT NULL GROUP BY 1) m ON m.k = '10.1/x' || (l_partkey // 12) WHERE l_linenumber = 2) SELECT c.citing, c.cited, 'method+influential' AS context FROM citations c JOIN named n ON n.citing = c.citing AND n.cited = c.cited")
def intent_labels(x: Fixture) -> DataFrame:
    given = x.table("lineitem").where("l_linenumber = 2").select(F.concat(F.lit("p"), "l_orderkey").alias("paper_id"), F.concat(F.lit("DOI:10.1/X").substr(F.lit(5), F.lit(6)), F.expr("l_partkey div 12")).alias("doi"), T.intent_label(F.array(F.lit("method")), F.lit(True)).alias("label"))
    return graph.label_intents(x.citations().drop("order_key"), given, x.papers()).where("changed").select("citing", "cited", "context")


@query("SELECT t.id, t.depth, coalesce(p.depth + 1, 0) AS depth_by_parent FROM topics t LEFT JOIN topics p ON t.parent_topic_id = p.id")
def topic_depth(x: Fixture) -> DataFrame:
    return topics.with_depth(x.topics()).select("id", "depth", "depth_by_parent")


@query("WITH RECURSIVE up(topic, ancestor, distance) AS (SELECT id, id, 0 FROM topics UNION ALL SELECT u.topic, t.parent_topic_id, u.distance + 1 FROM up u JOIN topics t ON u.ancestor = t.id WHERE t.parent_topic_id IS NOT NULL) SELECT * FROM up")
def topic_ancestors(x: Fixture) -> DataFrame:
    return topics.ancestors(x.topics())


# -- topics ----------------------------------------------------------------------------------------------------------

_BRIEF = """pp AS (SELECT topic_id, string_agg(paper_id, ',' ORDER BY relevance DESC, paper_id) AS papers FROM topic_papers GROUP BY topic_id),
 gg AS (SELECT topic_id, string_agg(id, ',' ORDER BY priority DESC, id) AS gaps FROM gaps GROUP BY topic_id)"""


def _brief(x: Fixture) -> DataFrame:
    return topics.briefs(x.topics(), x.state(), x.papers(), x.topic_papers(), x.gaps())


def _ids(column: str):
    return F.array_join(F.transform(column, lambda s: s["id"]), ",")


@query(f"WITH {_BRIEF} SELECT t.id AS topic_id, t.name, s.coverage_score AS coverage, coalesce(pp.papers, '') AS papers, md5(coalesce(gg.gaps, '')) AS gaps FROM topics t LEFT JOIN state s ON s.topic_id = t.id LEFT JOIN pp ON pp.topic_id = t.id LEFT JOIN gg ON gg.topic_id = t.id")
def topic_brief(x: Fixture) -> DataFrame:
    return _brief(x).select("topic_id", "name", F.col("state.coverage_score").alias("coverage"), _ids("papers").alias("papers"), F.md5(_ids("gaps")).alias("gaps"))


@query(f"WITH {_BRIEF} SELECT CASE t.id WHEN 'n5' THEN 0 WHEN 'r1' THEN 1 ELSE 2 END AS position, t.id AS topic_id, coalesce(pp.papers, '') AS papers, md5(coalesce(gg.gaps, '')) AS gaps FROM topics t LEFT JOIN pp ON pp.topic_id = t.id LEFT JOIN gg ON gg.topic_id = t.id WHERE t.id IN ('n5', 'r1', 'n2')")
def report_material(x: Fixture) -> DataFrame:
    return topics.report_material(["n5", "r1", "n2"], _brief(x)).select("position", "topic_id", _ids("papers").alias("papers"), F.md5(_ids("gaps")).alias("gaps"))


_LINE = "'- ' || title || ': ' || abstract_text || chr(10)"
_ORDER = "PARTITION BY topic_id ORDER BY relevance DESC, created_at DESC, paper_id"


@query(f"SELECT topic_id, paper_id, position, cost FROM (SELECT topic_id, paper_id, CAST(ceil(length({_LINE}) / 4.0) AS BIGINT) AS cost, row_number() OVER w AS position, sum(ceil(length({_LINE}) / 4.0)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM topic_papers t JOIN papers p ON p.id = t.paper_id WINDOW w AS ({_ORDER})) WHERE used <= 4000 OR position = 1")
def report_context(x: Fixture) -> DataFrame:
    return topics.report_context(x.papers(), x.topic_papers()).select("topic_id", "paper_id", "position", "cost")


@query("SELECT id, cost, used FROM (SELECT id, CAST(cost AS BIGINT) AS cost, CAST(sum(cost) OVER (ORDER BY created_at DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT id, created_at, ceil(length(id || '|' || title || chr(10) || substring(abstract_text, 1, 600) || chr(10) || chr(10)) / 4.0) AS cost FROM papers WHERE keywords = '')) WHERE used <= 3000")
def keyword_batch(x: Fixture) -> DataFrame:
    return topics.keyword_batch(x.papers()).select("id", "cost", "used")


@query(f"SELECT topic_id, md5(CASE WHEN ceil(length(t) / 4.0) > 6000 THEN substring(t, 1, 24000) ELSE t END) AS context FROM (SELECT topic_id, string_agg('Title: ' || title || chr(10) || 'Abstract: ' || abstract_text || chr(10), chr(10) || '---' || chr(10) {_ORDER.removeprefix('PARTITION BY topic_id ')}) AS t FROM topic_papers t JOIN papers p ON p.id = t.paper_id GROUP BY topic_id)")
def gap_context(x: Fixture) -> DataFrame:
    return topics.gap_context(x.papers(), x.topic_papers()).select("topic_id", F.md5("context").alias("context"))


@query("SELECT o_orderkey, o_orderpriority AS description, CASE WHEN o_orderkey % 3 = 0 THEN 'methodology_gap' ELSE 'missing_literature' END AS gap_type, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, o_totalprice / 100000 - 0.5)) END AS priority FROM orders WHERE o_orderkey % 5 <> 0")
def record_gaps(x: Fixture) -> DataFrame:
    k = F.col("o_orderkey")
    rows = x.table("orders").select("o_orderkey", F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"))).alias("description"), F.when(k % 3 == 0, "methodology_gap").otherwise("?").alias("gap_type"), F.when(k % 7 != 0, F.col("o_totalprice") / 100000 - 0.5).alias("priority"))
    return topics.record_gaps(rows)


@query("SELECT coalesce(s.topic_id, g.topic_id) AS topic_id, coalesce(g.n, 0) AS gaps_identified, coalesce(papers_read, 0) AS papers_read, coalesce(coverage_score, 0) AS coverage_score FROM state s FULL JOIN (SELECT topic_id, count(*) AS n FROM gaps GROUP BY topic_id) g ON g.topic_id = s.topic_id")
def gap_counts(x: Fixture) -> DataFrame:
    return topics.refresh_gap_counts(x.state(), x.gaps()).select("topic_id", "gaps_identified", "papers_read", "coverage_score")


@query("SELECT 'p' || doc_id AS id, lang AS keywords, doc_id % 3 = 0 AS accepted FROM documents")
def enrich_accept(x: Fixture) -> DataFrame:
    replies = x.table("documents").select(F.concat(F.lit("p"), "doc_id").alias("id"), F.col("lang").alias("keywords"))
    return topics.accepted(x.papers().where("keywords = ''"), replies)


@query("SELECT topic_id, paper_id, CASE WHEN right(paper_id, 1) = '7' THEN 0.99 ELSE relevance END AS relevance FROM topic_papers")
def upsert_topic_links(x: Fixture) -> DataFrame:
    links = x.topic_papers()
    newer = links.where(F.col("paper_id").endswith("7")).withColumn("relevance", F.lit(0.99))
    log = links.withColumn("_seq", F.lit(0)).unionByName(newer.withColumn("_seq", F.lit(1)))
    return stats.latest(log, ["topic_id", "paper_id"], "_seq").drop("_seq")


@query("SELECT 'n4' AS topic_id, id AS paper_id FROM papers WHERE year = 2007")
def link_group(x: Fixture) -> DataFrame:
    return x.papers().where("year = 2007").select(F.lit("n4").alias("topic_id"), F.col("id").alias("paper_id"))


# -- counts ----------------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM papers WHERE reading_status = 'completed') AS papers_read, (SELECT count(*) FROM papers WHERE reading_status = 'queued') AS queued, (SELECT count(rating) FROM papers) AS rated, (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM gaps) AS gaps, (SELECT count(*) FROM reports) AS reports")
def overview(x: Fixture) -> DataFrame:
    return stats.overview(x.topics(), x.papers(rated=True), x.gaps(), x.reports())


@query("SELECT CASE status WHEN 'discovered' THEN 0 WHEN 'abstract_read' THEN 1 WHEN 'skimmed' THEN 2 WHEN 'read' THEN 3 ELSE 4 END AS position, status AS stage, count(*) AS n FROM papers GROUP BY status")
def pipeline_status(x: Fixture) -> DataFrame:
    return stats.funnel(x.papers(), "status")


@query("SELECT CASE reading_status WHEN 'unread' THEN 0 WHEN 'queued' THEN 1 WHEN 'in_progress' THEN 2 WHEN 'completed' THEN 3 ELSE 4 END AS position, reading_status AS stage, count(*) AS n FROM papers GROUP BY reading_status")
def pipeline_reading(x: Fixture) -> DataFrame:
    return stats.funnel(x.papers(), "reading_status")


@query("(SELECT 'paper' AS kind, created_at AS date, id, title AS label, CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv' WHEN s2_id IS NOT NULL THEN 'semantic_scholar' WHEN pdf_path IS NOT NULL THEN 'pdf' ELSE 'manual' END AS detail FROM papers ORDER BY created_at DESC, id LIMIT 500) UNION ALL (SELECT 'gap', discovered_at, id, description, topic_id FROM gaps ORDER BY discovered_at DESC, id LIMIT 500) UNION ALL (SELECT 'report', generated_at, id, title, '' FROM reports ORDER BY generated_at DESC, id LIMIT 500)")
def history_feed(x: Fixture) -> DataFrame:
    return stats.history(x.papers(), x.gaps(), x.reports())


@query("SELECT t.id, t.name, s.papers_read, s.papers_queued, CAST(round(s.coverage_score * 100) AS INTEGER) AS coverage FROM topics t LEFT JOIN state s ON s.topic_id = t.id")
def topic_states(x: Fixture) -> DataFrame:
    return topics.states(x.topics(), x.state()).select("id", "name", "papers_read", "papers_queued", F.round(F.col("coverage_score") * 100).cast("int").alias("coverage"))


# -- tag export ------------------------------------------------------------------------------------------------------

_PLAN = f"""p AS (SELECT id, {doi("doi")} AS k, created_at, seq, lang, source FROM papers), i AS (SELECT {doi("doi")} AS k, count(*) AS n, min(key) AS key, arg_min(version, key) AS version, arg_min(tags, key) AS tags FROM remote_items GROUP BY 1),
 u AS (SELECT p.k, list_filter(list_transform(any_value(i.tags), lambda t: trim(t)), lambda t: t <> '') AS cur, list(DISTINCT lang) || list(DISTINCT source) AS own FROM p JOIN i ON i.k = p.k GROUP BY p.k),
 o AS (SELECT p.id, CASE WHEN p.k IS NULL THEN 'no_doi' WHEN i.n IS NULL THEN 'not_in_remote' WHEN i.n > 1 THEN 'ambiguous' WHEN len(list_filter(u.own, lambda t: NOT list_contains(u.cur, t))) = 0 THEN 'unchanged' ELSE 'update' END AS outcome, i.key, i.version, i.n, len(u.cur) + len(list_filter(u.own, lambda t: NOT list_contains(u.cur, t))) AS n_merged FROM p LEFT JOIN i ON i.k = p.k LEFT JOIN u ON u.k = p.k)"""


@query(f"WITH {_PLAN} SELECT id, outcome, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n = 1 THEN version END AS version, CASE WHEN outcome = 'update' THEN n_merged END AS n_merged FROM o")
def tag_export_plan(x: Fixture) -> DataFrame:
    return export.plan(x.papers(), x.remote_items()).select("id", "outcome", "key", "version", F.when(F.col("merged").isNotNull(), F.size("merged")).cast("long").alias("n_merged"))


@query(f"WITH {_PLAN} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def tag_export_summary(x: Fixture) -> DataFrame:
    return export.summary(export.plan(x.papers(), x.remote_items()))


from . import source_queries  # noqa: E402, F401 -- adds the queries of the parsers
