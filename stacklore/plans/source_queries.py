"""Queries of the parsers, over service answers made of the tables: one JSON document for every twenty rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import export
from ..sources import atom, bibtex, json_sources, pages
from .catalogue import query
from .fixture_sql import SPACES
from .fixtures import Fixture

SQL_TITLE = "substring(split_part(text, chr(10), 1), 1, 80)"
SQL_STRIPPED = f"regexp_replace({SQL_TITLE}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _n() -> Column:
    return F.col("doc_id")


def _title() -> Column:
    return F.substring(F.substring_index("text", "\n", 1), 1, 80)


def _answers(rows: DataFrame, item: Column, before: str = "", after: str = "") -> DataFrame:
    lists = rows.groupBy(F.expr("doc_id div 20").alias("file")).agg(F.to_json(F.collect_list(item)).alias("content"))
    return lists.select(F.col("file").cast("string").alias("file"), F.concat(F.lit(before), "content", F.lit(after)).alias("content"))


def _shown(records: DataFrame) -> DataFrame:
    return records.select("title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", F.array_join("tags", "|").alias("tags"))


@query(f"SELECT {SQL_STRIPPED} AS title, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang || ' ' || source END AS authors, CAST(2000 + doc_id % 26 AS INTEGER) AS year, source AS venue, '10.1/x' || doc_id AS doi, lang || '|' || source AS tags FROM documents WHERE {SQL_STRIPPED} <> ''")
def source_csl(x: Fixture) -> DataFrame:
    year = F.array(F.array((2000 + _n() % 26).cast("string"), F.lit("1")))
    person = F.when(_n() % 3 == 0, F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.col("source").alias("literal"))).otherwise(F.struct(F.concat(F.lit(" "), "lang").alias("given"), F.col("source").alias("family"), F.lit(None).cast("string").alias("literal")))
    item = F.struct(_title().alias("title"), F.col("source").alias("container-title"), F.concat(F.lit("https://doi.org/10.1/X"), _n()).alias("DOI"), F.concat_ws("; ", "lang", "source").alias("keyword"), F.struct(year.alias("date-parts")).alias("issued"), F.array(person).alias("author"))
    return _shown(json_sources.bibliography(_answers(x.table("documents"), item)))


@query(f"SELECT {SQL_STRIPPED} AS title, lang || ' ' || source || '|' || 'Org ' || lang AS authors, CASE WHEN doc_id % 2 = 0 THEN CAST(1900 + doc_id % 100 AS INTEGER) END AS year, source AS venue, '10.1/x' || doc_id AS doi, lang || '|' || source AS tags FROM documents WHERE {SQL_STRIPPED} <> '' AND doc_id % 5 <> 4")
def source_zotero(x: Fixture) -> DataFrame:
    null = F.lit(None).cast("string")
    names = F.array(F.struct(F.col("lang").alias("firstName"), F.col("source").alias("lastName"), null.alias("name")), F.struct(null.alias("firstName"), null.alias("lastName"), F.concat(F.lit("Org "), "lang").alias("name")))
    tags = F.transform(F.array(F.concat(F.lit(" "), "lang"), F.lit(" "), F.col("source")), lambda t: F.struct(t.alias("tag")))
    date = F.when(_n() % 2 == 0, F.concat(F.lit("May "), 1900 + _n() % 100)).otherwise("undated 12")
    kind = F.when(_n() % 5 == 4, "attachment").otherwise("article")
    data = F.struct(kind.alias("itemType"), _title().alias("title"), F.col("source").alias("publicationTitle"), F.concat(F.lit("doi:10.1/X"), _n()).alias("DOI"), date.alias("date"), names.alias("creators"), tags.alias("tags"))
    return _shown(json_sources.bibliography(_answers(x.table("documents"), F.struct(F.concat(F.lit("K"), _n()).alias("key"), _n().alias("version"), data.alias("data")))))


def _work() -> Column:
    words = F.map_from_arrays(F.array("lang", "source"), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1))))
    return F.struct(
        F.concat(F.lit("https://openalex.org/W"), _n()).alias("id"), F.concat(F.lit("https://doi.org/10.1/X"), _n()).alias("doi"), _title().alias("display_name"), (2000 + _n() % 26).alias("publication_year"), F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"),
        F.array(F.struct(F.struct(F.concat_ws(" ", "lang", "source").alias("display_name")).alias("author"))).alias("authorships"), words.alias("abstract_inverted_index"), F.transform(F.sequence(_n() + 1, _n() + _n() % 3 + 1), lambda k: F.concat(F.lit("https://openalex.org/W"), k)).alias("referenced_works"),
    )


@query(f"SELECT 'W' || doc_id AS openalex_id, {SQL_TITLE} AS title, lang || ' ' || source AS authors, lang || ' ' || source || ' ' || lang AS abstract_text, CAST(2000 + doc_id % 26 AS INTEGER) AS year, '10.1/x' || doc_id AS doi FROM documents WHERE {SQL_STRIPPED} <> ''")
def source_openalex(x: Fixture) -> DataFrame:
    rows = json_sources.openalex(_answers(x.table("documents"), _work(), '{"results":', "}"))
    return rows.select("openalex_id", "title", F.array_join("authors", "|").alias("authors"), "abstract_text", "year", "doi")


@query("SELECT 'W' || doc_id AS source_id, 'W' || k AS openalex_id FROM documents, unnest(range(doc_id + 1, doc_id + doc_id % 3 + 2)) t(k)")
def source_openalex_references(x: Fixture) -> DataFrame:
    return json_sources.openalex_references(x.table("documents").select(F.to_json(_work()).alias("content")))


@query(f"SELECT {SQL_TITLE} AS title, lang || '|' || source AS authors, CASE WHEN doc_id % 4 <> 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year, source AS venue, '10.1/x' || doc_id AS doi, 'https://europepmc.org/article/' || CASE WHEN doc_id % 2 = 0 THEN 'PPR' ELSE 'MED' END || '/' || doc_id AS url FROM documents WHERE {SQL_STRIPPED} <> ''")
def source_europe_pmc(x: Fixture) -> DataFrame:
    item = F.struct(
        _n().cast("string").alias("id"), F.when(_n() % 2 == 0, "PPR").otherwise("MED").alias("source"), _title().alias("title"), F.when(_n() % 4 == 0, "in press").otherwise((1990 + _n() % 30).cast("string")).alias("pubYear"), F.concat(F.lit("10.1/X"), _n()).alias("doi"),
        F.struct(F.struct(F.col("source").alias("title")).alias("journal")).alias("journalInfo"), F.struct(F.transform(F.array("lang", "source"), lambda a: F.struct(a.alias("fullName"))).alias("author")).alias("authorList"),
    )
    rows = json_sources.europe_pmc(_answers(x.table("documents"), item, '{"resultList":{"result":', "}}"))
    return rows.select("title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "url")


@query(f"SELECT {SQL_TITLE} AS title, 'https://europepmc.org/article/PPR/' || doc_id AS url FROM documents WHERE {SQL_STRIPPED} <> '' AND doc_id % 2 = 0")
def source_preprints(x: Fixture) -> DataFrame:
    item = F.struct(_n().cast("string").alias("id"), F.when(_n() % 2 == 0, "PPR").otherwise("MED").alias("source"), _title().alias("title"))
    return json_sources.europe_pmc(_answers(x.table("documents"), item, '{"resultList":{"result":', "}}"), preprints=True).select("title", "url")


@query(f"SELECT CASE WHEN doc_id % 6 = 0 THEN '' ELSE {SQL_TITLE} END AS title, lang AS authors, CAST(2000 + doc_id % 26 AS INTEGER) AS year, '10.1/x' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '2301.' || doc_id END AS arxiv_id, 's' || doc_id AS s2_id FROM documents")
def source_semantic_scholar(x: Fixture) -> DataFrame:
    item = F.struct(
        F.concat(F.lit("s"), _n()).alias("paperId"), F.when(_n() % 6 != 0, _title()).alias("title"), F.array(F.struct(F.col("lang").alias("name"))).alias("authors"), (2000 + _n() % 26).alias("year"),
        F.struct(F.when(_n() % 2 == 0, F.concat(F.lit("2301."), _n())).alias("ArXiv"), F.concat(F.lit("10.1/X"), _n()).alias("DOI")).alias("externalIds"),
    )
    rows = json_sources.semantic_scholar(_answers(x.table("documents"), item, '{"data":', "}"))
    return rows.select("title", F.array_join("authors", "|").alias("authors"), "year", "doi", "arxiv_id", "s2_id")


@query("SELECT '10.1/x' || doc_id AS doi, 's' || doc_id AS s2_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END || CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE '+' END || 'influential' ELSE '' END AS label FROM documents")
def source_citation_intents(x: Fixture) -> DataFrame:
    paper = F.struct(F.concat(F.lit("s"), _n()).alias("paperId"), F.struct(F.concat(F.lit("10.1/X"), _n()).alias("DOI")).alias("externalIds"))
    intents = F.when(_n() % 3 != 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    item = F.struct(intents.alias("intents"), (_n() % 2 == 0).alias("isInfluential"), F.when(_n() % 5 != 0, paper).alias("citedPaper"), F.when(_n() % 5 == 0, paper).alias("citingPaper"))
    return json_sources.citation_intents(_answers(x.table("documents"), item, '{"data":', "}")).select("doi", "s2_id", "label")


@query("SELECT 'K' || doc_id AS key, doc_id AS version, CASE WHEN doc_id % 4 <> 0 THEN '10.1/X' || doc_id END AS doi, lang || '|' || source AS tags FROM documents")
def source_remote_items(x: Fixture) -> DataFrame:
    data = F.struct(F.lit("article").alias("itemType"), F.when(_n() % 4 != 0, F.concat(F.lit("10.1/X"), _n())).alias("DOI"), F.transform(F.array("lang", "source"), lambda t: F.struct(t.alias("tag"))).alias("tags"))
    rows = json_sources.remote_items(_answers(x.table("documents"), F.struct(F.concat(F.lit("K"), _n()).alias("key"), _n().alias("version"), data.alias("data"))))
    return rows.select("key", "version", "doi", F.array_join("tags", "|").alias("tags"))


@query(f"SELECT {SQL_STRIPPED} AS title, '10.1/x' || doc_id AS doi FROM documents WHERE {SQL_STRIPPED} <> '' AND doc_id % 5 <> 4 ORDER BY lpad(CAST(doc_id // 20 AS VARCHAR), 9, '0'), doc_id LIMIT 150")
def source_remote_papers(x: Fixture) -> DataFrame:
    """The limit is the feature: so many papers of the remote library are taken, attachments not counted."""
    data = F.struct(F.when(_n() % 5 == 4, "attachment").otherwise("article").alias("itemType"), _title().alias("title"), F.concat(F.lit("10.1/X"), _n()).alias("DOI"))
    item = F.struct(F.lpad(_n().cast("string"), 9, "0").alias("key"), data.alias("data"))
    pages_of = _answers(x.table("documents"), item)
    ordered = pages_of.withColumn("file", F.lpad("file", 9, "0")).withColumn("content", F.to_json(F.array_sort(F.from_json("content", "array<struct<key:string,data:struct<itemType:string,title:string,DOI:string>>>"))))
    return json_sources.remote_papers(ordered, 150).select("title", "doi")


_ATOM_TITLE = "trim(regexp_replace('On ' || lang || ' & ' || source || chr(10) || '  <' || doc_id || '>', '\\s+', ' ', 'g'))"


@query(f"SELECT {_ATOM_TITLE} AS title, lang || '|' || source AS authors, CAST(2000 + doc_id % 26 AS INTEGER) AS year, '2301.' || doc_id AS arxiv_id, 'https://arxiv.org/abs/2301.' || doc_id AS url FROM documents")
def source_atom(x: Fixture) -> DataFrame:
    """One feed for every twenty rows; titles have entities and broken lines."""
    name = lambda c: F.concat(F.lit("<author><name> "), c, F.lit(" </name></author>"))
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2301."), _n(), F.lit("v3</id><title>On "), "lang", F.lit(" &amp; "), "source", F.lit("\n  &lt;"), _n(), F.lit("&gt;</title><published>"), 2000 + _n() % 26, F.lit("-05-01T00:00:00Z</published>"), name(F.col("lang")), name(F.col("source")), F.lit("</entry>"),
    )
    feeds = x.table("documents").groupBy(F.expr("doc_id div 20")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("content"))
    return atom.papers(atom.entries(feeds)).select("title", F.array_join("authors", "|").alias("authors"), "year", "arxiv_id", "url")


@query("SELECT 'The {' || lang || '} case ' || doc_id AS title, 'Ann van ' || lang || '|' || source || ' Roe' AS authors, CAST(1950 + doc_id % 70 AS INTEGER) AS year, 'Journal of ' || source AS venue, '10.1/x' || doc_id AS doi, lang || '|' || source AS tags FROM documents WHERE doc_id % 7 <> 3".replace("{' || lang || '}", "' || lang || '"))
def source_bibtex(x: Fixture) -> DataFrame:
    """One file for every twenty rows, with names of strings, nested braces, and entries without a title."""
    title = F.when(_n() % 7 != 3, F.concat(F.lit("  title = {The {"), "lang", F.lit("} case "), _n(), F.lit("},\n")))
    entry = F.concat(
        F.lit("@article{k"), _n(), F.lit(",\n"), F.coalesce(title, F.lit("")), F.lit('  author = "van '), "lang", F.lit(", Ann and "), F.col("source"), F.lit(' Roe",\n  year = '), 1950 + _n() % 70, F.lit(',\n  journal = "Journal of " # {'), "source", F.lit("},\n  doi = {https://doi.org/10.1/X"), _n(), F.lit("},\n  keywords = {"), "lang", F.lit("; "), "source", F.lit("}\n}\n"),
    )
    files = x.table("documents").groupBy(F.expr("doc_id div 20").cast("string").alias("file")).agg(F.array_join(F.collect_list(entry), "\n").alias("content"))
    return _shown(bibtex.parse(files))


@query("SELECT CAST(doc_id // 20 AS VARCHAR) AS file FROM documents WHERE doc_id // 20 % 3 = 1 GROUP BY 1")
def source_unreadable(x: Fixture) -> DataFrame:
    """Every third document is cut short, as a broken download is."""
    whole = _answers(x.table("documents"), F.struct(_title().alias("title")))
    cut = F.when(F.col("file").cast("long") % 3 == 1, F.expr("substring(content, 1, length(content) - 1)")).otherwise(F.col("content"))
    return json_sources.unreadable(whole.withColumn("content", cut)).select("file")


@query("SELECT 'conv ' || conv_id AS title, md5(string_agg('<!-- page ' || n || ' -->' || chr(10) || text || CASE WHEN suffix(text, chr(10)) THEN '' ELSE chr(10) END, '' ORDER BY n)) AS body FROM (SELECT conv_id, 'x' || text AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, 'page ' || turn AS text FROM conversations)) GROUP BY conv_id")
def source_pages(x: Fixture) -> DataFrame:
    rows = x.table("conversations").select(F.concat(F.lit("/in/conv "), "conv_id", F.lit(".PDF")).alias("file"), F.col("turn").alias("page"), F.concat(F.lit("xpage "), "turn").alias("text"))
    return pages.papers_and_bodies(rows).select("title", F.md5("body").alias("body"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'failed' WHEN 2 THEN 'update' ELSE 'unchanged' END AS outcome FROM documents) GROUP BY 1")
def export_settled(x: Fixture) -> DataFrame:
    planned = x.table("documents").select(_n().alias("id"), F.when(_n() % 4 == 3, "unchanged").otherwise("update").alias("outcome"), F.concat(F.lit("z"), _n()).alias("key"))
    answers = x.table("documents").select(F.concat(F.lit("z"), _n()).alias("key"), F.when(_n() % 4 == 0, 412).when(_n() % 4 == 1, 500).otherwise(204).alias("status"))
    return export.summary(export.settled(planned, answers))


@query("SELECT 'p' || doc_id AS id, '(' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ', ' END || 'p.' || doc_id % 7 || ')' AS place, CAST(len(string_split(lang || ' ,' || source, ',')) AS INTEGER) AS n_listed FROM documents")
def place_and_list(x: Fixture) -> DataFrame:
    section = F.when(_n() % 3 != 0, F.col("source"))
    return x.table("documents").select(F.concat(F.lit("p"), _n()).alias("id"), T.place(section, _n() % 7).alias("place"), F.size(T.comma_list(F.concat("lang", F.lit(" ,"), "source"))).alias("n_listed"))
