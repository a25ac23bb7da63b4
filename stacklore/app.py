"""What a user does with a library, as methods and as commands."""

from __future__ import annotations

import argparse
import json
import uuid
from dataclasses import asdict
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .errors import LibraryError, NotFound, Serialization, Validation
from .functions import text as T
from .library import Library
from .operators import export, graph, identity, scans, search, stats, topics
from .schema import MAX_KEYWORDS, TABLES
from .scratch import Scratch
from .sources import atom, bibtex, json_items, json_sources, pages
from .streaming import imports


class Research:
    """One library with all of its questions. Ids and times are made here, when something is written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.library = spark, Library(spark, root)

    def _one(self, table: str, **values) -> None:
        schema = TABLES[table][0]
        row = self.spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        self.library.upsert(table, row.withColumns({c: F.coalesce(c, now) for c in ("created_at", "discovered_at", "generated_at", "last_updated") if c in schema.names}))

    def _topic(self, topic_id: str):
        found = scans.get(self.library.read("topics"), "id", topic_id).first()
        if found is None:
            raise Validation(f"no such topic: {topic_id}")
        return found

    # papers ------------------------------------------------------------------------------------------------------

    def store(self, records: DataFrame, topic_id: str | None = None) -> dict[str, int]:
        """Stores the records that the library lacks; all of them, old and new, are linked to the topic. Their ids are
        written down before they are used, so that a lost executor can't make others."""
        if topic_id is not None:
            self._topic(topic_id)
        scratch = Scratch(self.spark)
        stamped = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        fill = {c: F.lit(None).cast("string") for c in ("doi", "pdf_path") if c not in records.columns}
        rows = scratch.save(records.withColumns(fill | {"id": F.expr("uuid()"), "seq": F.monotonically_increasing_id(), "created_at": stamped, "updated_at": stamped}), "rows")
        resolved = scratch.save(identity.resolve_batch(rows, self.library.read("papers").withColumn("seq", F.lit(0).cast("long"))), "resolved")
        n, new = resolved.count(), resolved.where("is_new")
        added = new.count()
        if added:
            self.library.upsert("papers", new.drop("seq", "matched_id", "matched_by", "is_new"))
            if "body" in rows.columns:
                self.library.upsert("bodies", new.where("body is not null").select(F.col("id").alias("paper_id"), "body"))
        if topic_id is not None and n:
            self.library.upsert("topic_papers", resolved.select(F.lit(topic_id).alias("topic_id"), F.coalesce("matched_id", "id").alias("paper_id"), F.lit(0.5).alias("relevance")).distinct())
        scratch.keep()
        return {"imported": added, "skipped_duplicates": n - added}

    def import_papers(self, path: str, topic_id: str | None = None) -> dict:
        """Files of a bibliography, in BibTeX or JSON; a file that can't be read, or has an item that can't, is reported and
        the others count. Large JSON files are read by many tasks (see ``json_items``). Parsed records are written down once,
        for the count of failures and for the library."""
        done: dict = {"imported": 0, "skipped_duplicates": 0, "failed": []}
        scratch = Scratch(self.spark)
        bib = scratch.save(bibtex.parse(json_sources.read_documents(self.spark, path, "bib,bibtex")), "bib")
        documents = scratch.save(json_sources.read_documents(self.spark, path, "json", json_items.LARGE), "json")
        found = [bib.where("error is null").drop("error", "file"), json_sources.bibliography(documents).drop("file")]
        bad = bib.where("error is not null").select("file").unionByName(json_sources.unreadable(documents).select("file"))
        if large := json_sources.large_files(self.spark, path, json_items.LARGE):
            items = scratch.save(json_items.read_items(self.spark, large, scratch), "items")
            found.append(json_items.bibliography(items).drop("file"))
            bad = bad.unionByName(json_items.failures(items).select("file").distinct())
        done["failed"] += [r["file"] for r in bad.orderBy("file").collect()]
        for records in found:
            got = self.store(records, topic_id)
            done["imported"] += got["imported"]
            done["skipped_duplicates"] += got["skipped_duplicates"]
        scratch.keep()
        return done

    def landed(self, kind: str, path: str, limit: int | None = None) -> DataFrame:
        """Records of the answers of one service that lie in a folder; of page texts also their bodies, of a remote library
        the first ``limit``."""
        if kind == "atom":
            return atom.read(self.spark, path)
        if kind == "pages":
            found = pages.papers_and_bodies(self.spark.read.parquet(path))
            return found.withColumnRenamed("file", "pdf_path")
        if kind == "remote":
            return json_sources.remote_papers(json_sources.read_documents(self.spark, path, "json"), limit)
        return imports.records(kind, json_sources.read_documents(self.spark, path, imports.extension(kind)))

    def ingest(self, sources: list[tuple[str, str]], topic_id: str | None = None) -> dict:
        """Stores what (kind, path) sources hold, one after the other; a source that fails is reported and the others
        count."""
        done: dict = {"imported": 0, "skipped_duplicates": 0, "failed": []}
        if topic_id is not None:
            self._topic(topic_id)
        for kind, path in sources:
            try:
                got = self.store(self.landed(kind, path), topic_id)
            except (LibraryError, PySparkException, Py4JJavaError) as error:
                done["failed"].append(f"{kind} {path}: {str(error).splitlines()[0]}")
                continue
            done["imported"] += got["imported"]
            done["skipped_duplicates"] += got["skipped_duplicates"]
        return done

    def sync_references(self, paper_id: str, path: str, cited_by: bool = False) -> int:
        """Links a paper to the library's papers among the works in a folder: those it cites, or those that cite it. Gives
        the number of new edges."""
        one = self.library.get_paper(paper_id)
        if one.isEmpty():
            raise NotFound(f"papers: {paper_id}")
        works = json_sources.openalex_related(json_sources.read_documents(self.spark, path, "json")).withColumn("source_id", F.lit(paper_id))
        linked = identity.link_related(works, self.library.read("papers").withColumn("seq", F.lit(0).cast("long")))
        return self.library.insert_citations(graph.edges_of(linked, cited_by))

    def sync_intents(self, paper_id: str, path: str, cited_by: bool = False) -> int:
        """Labels a paper's stored edges, in one direction, by the intents in a folder. Gives the number of labels."""
        found = json_sources.citation_intents(json_sources.read_documents(self.spark, path, "json")).withColumn("paper_id", F.lit(paper_id))
        papers = self.library.read("papers").withColumn("seq", F.lit(0).cast("long"))
        return self.library.revise("citations", lambda edges: graph.label_intents(edges, found, papers, cited_by).where("changed").drop("changed"))

    def query(self, text: str, limit: int = 20) -> DataFrame:
        return self.library.search(text, scans.page(limit, 20, 1000))

    def evidence(self, text: str, limit: int = 10, paper_id: str | None = None) -> DataFrame:
        return self.library.evidence(text, scans.page(limit, 10, 1000), paper_id).withColumn("place", T.place(F.col("section"), F.col("page")))

    def body(self, paper_id: str) -> DataFrame:
        return scans.body_capped(scans.get(self.library.read("bodies"), "paper_id", paper_id))

    def references(self, paper_id: str, cited_by: bool = False) -> DataFrame:
        one = self.library.get_paper(paper_id)
        if one.isEmpty():
            raise NotFound(f"papers: {paper_id}")
        return graph.listing(self.library.read("citations"), self.library.read("papers"), one.select("id"), cited_by).orderBy("seq", "other_id")

    def keyword_reply(self, reply: str) -> int:
        """Keywords of a model's reply to papers that have none. Gives the number of papers; a reply without any valid line
        is an error."""
        lines = self.spark.createDataFrame([(reply,)], "reply string").select(F.inline(T.keyword_lines(F.col("reply"))))
        if lines.isEmpty():
            raise Serialization("no line of the reply has keywords")
        last = lines.groupBy("paper_id").agg(F.max("keywords").alias("new")).withColumnRenamed("paper_id", "id")
        return self.library.revise("papers", lambda papers: papers.where("keywords = ''").join(F.broadcast(last), "id").withColumn("keywords", F.substring("new", 1, MAX_KEYWORDS)).drop("new"))

    def gap_reply(self, topic_id: str, reply: str) -> int:
        """Gaps of a model's reply; one without any valid line is an error."""
        found = self.spark.createDataFrame([(reply,)], "reply string").select(F.inline(T.gap_lines(F.col("reply")))).collect()
        if not found:
            raise Serialization("no line of the reply has a gap")
        return self.record_gaps(topic_id, [{"gap_type": r["gap_type"], "description": r["description"]} for r in found])

    def missing_keywords(self, limit: int = 20, topic_id: str | None = None) -> DataFrame:
        n, papers = scans.page(limit, 20, 200), self.library.read("papers")
        return scans.missing_keywords(papers, n) if topic_id is None else scans.missing_keywords_by_topic(papers, self.library.read("topic_papers"), topic_id, n)

    def stalest(self, limit: int = 20, topic_id: str | None = None) -> DataFrame:
        n, papers = scans.page(limit, 20, 200), self.library.read("papers")
        return scans.stalest(papers, n) if topic_id is None else scans.stalest_by_topic(papers, self.library.read("topic_papers"), topic_id, n)

    def export_plan(self, items: DataFrame) -> DataFrame:
        return export.plan(self.library.read("papers").withColumn("seq", F.lit(0)), items)

    # topics and gaps ---------------------------------------------------------------------------------------------

    def topic_add(self, name: str, parent: str | None = None, priority: float = 0.5) -> str:
        key, depth = str(uuid.uuid4()), 0 if parent is None else self._topic(parent)["depth"] + 1
        self._one("topics", id=key, name=name, parent_topic_id=parent, depth=depth, priority=priority)
        return key

    def topics(self) -> DataFrame:
        return scans.list_topics(self.library.read("topics"))

    def briefs(self) -> DataFrame:
        read = self.library.read
        return topics.briefs(read("topics"), read("state"), read("papers"), read("topic_papers"), read("gaps"))

    def brief(self, topic_id: str) -> DataFrame:
        self._topic(topic_id)
        return self.briefs().where(F.col("topic_id") == topic_id)

    def record_gaps(self, topic_id: str, gaps: list[dict]) -> int:
        """Stores what is described, then counts the topic's gaps anew; all else of its state stays."""
        self._topic(topic_id)
        rows = self.spark.createDataFrame([(str(uuid.uuid4()), g.get("description") or "", topic_id, g.get("gap_type"), g.get("priority")) for g in gaps], "id string, description string, topic_id string, gap_type string, priority double")
        kept = topics.record_gaps(rows).withColumn("discovered_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).persist()
        n = kept.count()
        if n:
            self.library.upsert("gaps", kept)
            mine = lambda t: self.library.read(t).where(F.col("topic_id") == topic_id)
            self.library.upsert("state", topics.refresh_gap_counts(mine("state").drop("last_updated"), mine("gaps")))
        kept.unpersist()
        return n

    def gaps(self, topic_id: str | None = None) -> DataFrame:
        return scans.list_gaps(self.library.read("gaps"), topic_id)

    # reports and counts ------------------------------------------------------------------------------------------

    def report_material(self, topic_ids: str) -> DataFrame:
        return topics.report_material(self._list(topic_ids), self.briefs())

    def report_save(self, title: str, topic_ids: list[str], markdown: str) -> str:
        key = str(uuid.uuid4())
        given = self.spark.createDataFrame([(title, markdown)], "title string, md string")
        content = given.select(T.report_markdown(F.col("title"), T.sections_for_saving(F.col("md"))).alias("c")).first()["c"]
        self._one("reports", id=key, title=title, topic_ids=topic_ids, content=content)
        return key

    def _list(self, text: str) -> list[str]:
        found = self.spark.createDataFrame([(text,)], "t string").select(F.filter(T.comma_list(F.col("t")), lambda x: x != "").alias("l"))
        return found.first()["l"]

    def overview(self) -> DataFrame:
        return self.library.counts().overview()

    def pipeline(self, column: str = "status") -> DataFrame:
        return self.library.counts().funnel(column).orderBy("position")

    def history(self) -> DataFrame:
        read = self.library.read
        return stats.history(read("papers"), read("gaps"), read("reports"))

    def states(self) -> DataFrame:
        return topics.states(self.topics(), self.library.read("state"))

    def reingest_worklist(self) -> DataFrame:
        return scans.reingest_worklist(self.library.read("papers"), self.library.read("bodies"))

    def keyword_batch(self) -> DataFrame:
        return topics.keyword_batch(self.library.read("papers"))


def shown(rows: DataFrame, limit: int) -> str:
    """The first rows as JSON lines."""
    return "\n".join(rows.limit(limit).toJSON().collect())


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stacklore")
    parser.add_argument("root")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("values", nargs="*")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--topic")
    parser.add_argument("--json", action="store_true", help="rows as JSON lines")
    a = parser.parse_args(arguments)
    r = Research(SparkSession.builder.getOrCreate(), a.root)
    done = COMMANDS[a.command](r, a, *a.values)
    if isinstance(done, DataFrame):
        print(shown(done, a.limit)) if a.json else done.show(a.limit, truncate=100)
    elif done is not None:
        print(json.dumps(done) if a.json else done)


#: What each command does with its values.
COMMANDS = {
    "import": lambda r, a, path: r.import_papers(path, a.topic),
    "ingest": lambda r, a, *pairs: r.ingest(list(zip(pairs[::2], pairs[1::2], strict=True)), a.topic),
    "query": lambda r, a, *words: r.query(" ".join(words), a.limit),
    "evidence": lambda r, a, *words: r.evidence(" ".join(words), a.limit),
    "references": lambda r, a, paper: r.references(paper),
    "cited-by": lambda r, a, paper: r.references(paper, True),
    "sync-references": lambda r, a, paper, path: r.sync_references(paper, path),
    "sync-citers": lambda r, a, paper, path: r.sync_references(paper, path, True),
    "sync-intents": lambda r, a, paper, path: r.sync_intents(paper, path),
    "remote": lambda r, a, path: r.store(r.landed("remote", path, a.limit), a.topic),
    "states": lambda r, a: r.states(),
    "gap-reply": lambda r, a, topic, file: r.gap_reply(topic, Path(file).read_text(encoding="utf-8")),
    "watch": lambda r, a, kind, path, state: imports.watch(r.library, path, state, kind).awaitTermination(),
    "compact": lambda r, a, table: r.library.compact(table),
    "topics": lambda r, a: r.topics(),
    "topic-add": lambda r, a, name: r.topic_add(name, a.topic),
    "brief": lambda r, a, topic: r.brief(topic),
    "gaps": lambda r, a: r.gaps(a.topic),
    "report": lambda r, a, ids: r.report_material(ids),
    "report-save": lambda r, a, title, ids, file: r.report_save(title, r._list(ids), Path(file).read_text(encoding="utf-8")),
    "status": lambda r, a: r.overview(),
    "pipeline": lambda r, a: r.pipeline(),
    "history": lambda r, a: r.history(),
    "read": lambda r, a, paper, stage: r.library.set_reading_status(paper, stage),
    "rate": lambda r, a, paper, stars: r.library.set_rating(paper, int(stars) or None),
    "enrich": lambda r, a: r.missing_keywords(a.limit, a.topic),
    "keywords": lambda r, a, file: r.keyword_reply(Path(file).read_text(encoding="utf-8")),
    "reingest": lambda r, a: r.reingest_worklist(),
    "export": lambda r, a, path: r.export_plan(json_sources.remote_items(json_sources.read_documents(r.spark, path, "json"))),
    "index": lambda r, a: r.library.rebuild_index(),
    "init": lambda r, a, path: asdict(Settings.load_or_create(path)),
}


if __name__ == "__main__":
    main()
