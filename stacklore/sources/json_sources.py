"""Paper records from JSON documents: one row per document in, one row per record out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Source
from ..functions import text as T

COLUMNS = ("title", "authors", "abstract_text", "year", "venue", "doi", "arxiv_id", "s2_id", "openalex_id", "url", "tags")
_KINDS = {"authors": "array<string>", "tags": "array<string>", "year": "int"}

# The shapes of the services' answers.
CSL = "array<struct<title:string,`container-title`:string,DOI:string,URL:string,abstract:string,keyword:string,issued:struct<`date-parts`:array<array<string>>>,author:array<struct<given:string,family:string,literal:string>>>>"
_ITEM = "itemType:string,title:string,abstractNote:string,publicationTitle:string,DOI:string,url:string,date:string,creators:array<struct<firstName:string,lastName:string,name:string>>,tags:array<struct<tag:string>>"
ZOTERO = f"array<struct<key:string,version:bigint,data:struct<{_ITEM}>,{_ITEM}>>"
OPENALEX_WORK = "struct<id:string,doi:string,display_name:string,publication_year:int,primary_location:struct<source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>,referenced_works:array<string>>"
EUROPE_PMC = "struct<resultList:struct<result:array<struct<id:string,source:string,title:string,pubYear:string,doi:string,abstractText:string,journalInfo:struct<journal:struct<title:string>>,authorList:struct<author:array<struct<fullName:string>>>>>>>"
S2 = "struct<data:array<struct<paperId:string,title:string,authors:array<struct<name:string>>,abstract:string,year:int,venue:string,externalIds:struct<ArXiv:string,DOI:string>>>>"
_EDGE = "struct<paperId:string,externalIds:struct<DOI:string>>"
S2_EDGES = f"struct<data:array<struct<intents:array<string>,isInfluential:boolean,citedPaper:{_EDGE},citingPaper:{_EDGE}>>>"
NOT_PAPERS = ("attachment", "note", "annotation")


def _records(rows: DataFrame, **columns: Column) -> DataFrame:
    """All paper columns; those not given are null. Untitled records go."""
    made = [columns.get(c, F.lit(None)).cast(_KINDS.get(c, "string")).alias(c) for c in COLUMNS]
    keep = [c for c in ("file",) if c in rows.columns]
    return rows.select(*keep, *made).where(T.strip(F.coalesce("title", F.lit(""))) != "")


def _files(spark: SparkSession, path: str, extensions: str) -> DataFrame:
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions.replace("*.", "").split(",")) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)


def read_documents(spark: SparkSession, path: str, extensions: str = "*.json", most: int | None = None) -> DataFrame:
    """file, content of the files of a folder (not of folders below it), in any case of the extension; of those up to
    ``most`` bytes, if given."""
    files = _files(spark, path, extensions)
    files = files if most is None else files.where(F.col("length") <= most)
    return files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))


def large_files(spark: SparkSession, path: str, least: int, extensions: str = "*.json") -> list[str]:
    """The names of the files of more than ``least`` bytes, which aren't read here."""
    return [r["path"] for r in _files(spark, path, extensions).where(F.col("length") > least).select("path").collect()]


def is_zotero(content: Column) -> Column:
    return F.get_json_object(content, "$[0].itemType").isNotNull() | F.get_json_object(content, "$[0].data.itemType").isNotNull()


def csl(documents: DataFrame) -> DataFrame:
    rows = documents.withColumn("r", F.explode(F.from_json("content", CSL)))
    year = F.get(F.get(F.col("r.issued")["date-parts"], F.lit(0)), F.lit(0)).try_cast("int")
    names = F.filter(F.transform("r.author", lambda a: F.coalesce(T.blank_to_null(T.author_name(a["given"], a["family"])), a["literal"])), lambda x: x.isNotNull())
    return _records(rows, title=T.strip(F.col("r.title")), authors=names, abstract_text=F.col("r.abstract"), year=F.when(year > 0, year), venue=F.col("r")["container-title"], doi=T.normalize_doi(F.col("r.DOI")), url=F.col("r.URL"), tags=T.split_keywords(F.col("r.keyword")))


def zotero(documents: DataFrame) -> DataFrame:
    """Flat items and items nested in ``data``; attachments and notes go. A malformed file is an error."""
    broken = unreadable(documents).limit(1).collect()
    if broken:
        raise Source(f"malformed items in {broken[0]['file'] if 'file' in documents.columns else 'document'}")
    return _zotero(documents)


def _zotero(documents: DataFrame) -> DataFrame:
    return _zotero_items(documents.withColumn("r", F.explode(F.from_json("content", ZOTERO))))


def _zotero_items(rows: DataFrame) -> DataFrame:
    f = lambda n: F.coalesce(F.col(f"r.data.{n}"), F.col(f"r.{n}"))
    rows = rows.where(~F.coalesce(f("itemType"), F.lit("")).isin(*NOT_PAPERS))
    names = F.filter(F.transform(f("creators"), lambda a: F.coalesce(T.blank_to_null(T.author_name(a["firstName"], a["lastName"])), T.blank_to_null(T.strip(a["name"])))), lambda x: x.isNotNull())
    tags = F.filter(F.transform(f("tags"), lambda t: T.strip(t["tag"])), lambda x: x != "")
    return _records(rows, title=T.strip(f("title")), authors=names, abstract_text=f("abstractNote"), year=T.year_from_text(f("date")), venue=f("publicationTitle"), doi=T.normalize_doi(f("DOI")), url=f("url"), tags=tags)


def remote_papers(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers of a remote library's landed pages (file, content): the first ``limit`` in order of page and item, counted
    without attachments, notes and untitled items. A page that can't be read is an error, as a failed request is."""
    broken = unreadable(documents).limit(1).collect()
    if broken:
        raise Source(f"malformed page {broken[0]['file']}")
    items = documents.select("file", F.posexplode(F.from_json("content", ZOTERO)).alias("item", "r"))
    if limit is None:
        return _zotero_items(items).drop("file")
    place = F.concat_ws("\x00", "file", F.lpad(F.col("item").cast("string"), 10, "0"))  # carried as the record's file
    return _zotero_items(items.withColumn("file", place)).orderBy("file").limit(limit).drop("file")


def is_list(content: Column) -> Column:
    """Whether a text is a JSON array of objects."""
    parsed = F.try_parse_json(content)
    array = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    items = F.try_variant_get(F.when(array, parsed), "$", "array<variant>")
    return array & F.forall(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))


def unreadable(documents: DataFrame) -> DataFrame:
    """The documents that no dialect can be read from: no array, or one with items that aren't objects."""
    return documents.where(~is_list(F.col("content")))


def bibliography(documents: DataFrame) -> DataFrame:
    """JSON files of either dialect, told apart by their first element. Documents that aren't arrays of objects give
    nothing, whatever else they hold; ``unreadable`` lists them."""
    documents = documents.where(is_list(F.col("content")))
    return csl(documents.where(~is_zotero(F.col("content")))).unionByName(_zotero(documents.where(is_zotero(F.col("content")))))


def _work(rows: DataFrame) -> DataFrame:
    return _records(
        rows, title=F.col("r.display_name"), authors=F.transform("r.authorships", lambda a: a["author"]["display_name"]), abstract_text=T.abstract_rebuild(F.col("r.abstract_inverted_index")), year=F.col("r.publication_year"),
        venue=F.col("r.primary_location.source.display_name"), doi=T.normalize_doi(F.col("r.doi")), openalex_id=T.work_id(F.col("r.id")), url=F.col("r.id"),
    )


def openalex(documents: DataFrame) -> DataFrame:
    return _work(documents.withColumn("r", F.explode(F.from_json("content", f"struct<results:array<{OPENALEX_WORK}>>")["results"])))


def openalex_references(works: DataFrame) -> DataFrame:
    """source_id, openalex_id of each reference of single work documents."""
    r = F.from_json("content", OPENALEX_WORK)
    return works.select(T.work_id(r["id"]).alias("source_id"), F.explode(r["referenced_works"]).alias("ref")).select("source_id", T.work_id(F.col("ref")).alias("openalex_id"))


def openalex_related(documents: DataFrame) -> DataFrame:
    """openalex_id, doi of the works in answers: what a work's references or citers hydrate to."""
    return openalex(documents).select("openalex_id", "doi")


def europe_pmc(documents: DataFrame, preprints: bool = False) -> DataFrame:
    rows = documents.withColumn("r", F.explode(F.from_json("content", EUROPE_PMC)["resultList"]["result"]))
    rows = rows.where(F.col("r.source") == "PPR") if preprints else rows
    url = F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("r.source", F.lit("MED")), F.lit("/"), F.col("r.id"))
    return _records(rows, title=F.col("r.title"), authors=F.transform("r.authorList.author", lambda a: a["fullName"]), abstract_text=F.col("r.abstractText"), year=F.col("r.pubYear").try_cast("int"), venue=F.col("r.journalInfo.journal.title"), doi=T.normalize_doi(F.col("r.doi")), url=url)


def semantic_scholar(documents: DataFrame) -> DataFrame:
    """A missing title is empty here, and the record stays."""
    rows = documents.withColumn("r", F.explode(F.from_json("content", S2)["data"]))
    made = {"title": F.coalesce("r.title", F.lit("")), "authors": F.transform("r.authors", lambda a: a["name"]), "abstract_text": F.col("r.abstract"), "year": F.col("r.year"), "venue": F.col("r.venue"), "doi": T.normalize_doi(F.col("r.externalIds.DOI")), "arxiv_id": F.col("r.externalIds.ArXiv"), "s2_id": F.col("r.paperId"), "url": F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("r.paperId"))}
    return rows.select(*[made.get(c, F.lit(None)).cast(_KINDS.get(c, "string")).alias(c) for c in COLUMNS])


def citation_intents(documents: DataFrame) -> DataFrame:
    """doi, s2_id, label of each edge."""
    r = documents.select(*[c for c in documents.columns if c != "content"], F.explode(F.from_json("content", S2_EDGES)["data"]).alias("r"))
    other = F.coalesce("r.citedPaper", "r.citingPaper")
    label = T.intent_label(F.coalesce("r.intents", F.array().cast("array<string>")), F.coalesce("r.isInfluential", F.lit(False)))
    return r.select(*[c for c in r.columns if c != "r"], T.normalize_doi(other["externalIds"]["DOI"]).alias("doi"), other["paperId"].alias("s2_id"), label.alias("label"))


def remote_items(documents: DataFrame) -> DataFrame:
    """key, version, doi, tags of a remote library's pages."""
    r = documents.select(F.explode(F.from_json("content", ZOTERO)).alias("r"))
    f = lambda n: F.coalesce(F.col(f"r.data.{n}"), F.col(f"r.{n}"))
    return r.select("r.key", "r.version", f("DOI").alias("doi"), F.transform(f("tags"), lambda t: t["tag"]).alias("tags"))
