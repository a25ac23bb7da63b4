"""A library on disk: logs of committed batches, read as the latest state of each key.

Every write is one commit (see ``commits``): a reader sees whole batches or none, and may read an older version. Changes
that depend on what they read are committed only if nothing came between, else made anew. ``compact`` puts a snapshot in
place of the batches it was made of; rows that are committed meanwhile still count after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .commits import CommitLog, Conflict
from .counts import Counts
from .errors import NotFound, Validation
from .functions import text as T
from .operators import graph, scans, search
from .postings import WordIndex
from .schema import DEFAULTS, MAX_KEYWORDS, PAPER_STATUS, READING_STATUS, TABLES

#: The searched tables with their id and columns.
SEARCHED = {"papers": ("id", search.FIELDS), "bodies": ("paper_id", ("body",))}


class Library:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, table: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/{table}")

    def index(self, table: str) -> WordIndex:
        return WordIndex(self.spark, f"{self.root}/index/{table}", SEARCHED[table][1])

    def _latest(self, table: str, at: int | None, after: int = 0, upto: int | None = None) -> DataFrame | None:
        """The last row of each key, with ``_deleted``; columns that older batches lack get their defaults."""
        schema, keys = TABLES[table]
        log = self.log(table).read(at, after, upto)
        if log is None:
            return None
        w = Window.partitionBy(*keys).orderBy(F.desc("_order"), F.desc("_row"))
        rows = log.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        columns = []
        for f in schema.fields:
            c = F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            columns.append((F.coalesce(c, F.lit(DEFAULTS[f.name])).cast(f.dataType) if f.name in DEFAULTS else c).alias(f.name))
        return rows.select(*columns, "_deleted")

    def read(self, table: str, at: int | None = None) -> DataFrame:
        """The present rows, or those at an earlier version of the table; deleted keys are left out."""
        return self._present(table, self._latest(table, at))

    def _present(self, table: str, rows: DataFrame | None) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table][0]) if rows is None else rows.where("not _deleted").drop("_deleted")

    def upsert(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        """Later rows replace earlier ones of the same key; other tables keep what belongs to the key."""
        self.log(table).commit(self._write(table, rows, deleted))
        self._follow(table)

    def _write(self, table: str, rows: DataFrame, deleted: bool = False) -> str:
        known = {f.name for f in TABLES[table][0].fields}
        rows = rows.select(*[c for c in rows.columns if c in known])
        return self.log(table).write(rows.withColumns({"_row": F.monotonically_increasing_id(), "_deleted": F.lit(deleted)}))

    def revise(self, table: str, make: Callable[[DataFrame], DataFrame]) -> int:
        """Upserts what ``make`` makes of the table's rows, again if another commit came between; gives the number of
        rows. Nothing is committed for no rows."""
        log = self.log(table)
        while True:
            at = log.version()
            folder = self._write(table, make(self.read(table, at)))
            n = log.folder(folder).count()
            try:
                if n:
                    log.commit(folder, at)
            except Conflict:
                n = -1
            if n <= 0:
                log.discard(folder)
            if n >= 0:
                break
        if n:
            self._follow(table)
        return n

    def compact(self, table: str, keep_seconds: float = 3600.0) -> None:
        """One batch in place of those there are. What no version needs any more is deleted after ``keep_seconds``."""
        self._follow(table)
        log = self.log(table)
        at = log.version()
        live = log.live(at)
        if len(live) > 1:
            folder = self._write(table, self.read(table, at))
            try:
                log.commit(folder, replaces=live, order=live[-1]["order"], whole=at)
            except Conflict:  # another compaction came first
                log.discard(folder)
        log.vacuum(keep_seconds)

    def _change(self, table: str, key: str, value: str, required: bool = True, **columns) -> None:
        kinds = {f.name: f.dataType for f in TABLES[table][0].fields}
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        new = {k: (v if hasattr(v, "_jc") else F.lit(v)).cast(kinds[k]) for k, v in columns.items()} | ({"updated_at": now} if "updated_at" in kinds else {})
        if not self.revise(table, lambda rows: rows.where(F.col(key) == value).withColumns(new)) and required:
            raise NotFound(f"{table}: {value}")

    def set_body(self, paper_id: str, body: str) -> None:
        self.upsert("bodies", self.spark.createDataFrame([(paper_id, body)], TABLES["bodies"][0]))

    def set_pdf_path(self, paper_id: str, path: str) -> None:
        self._change("papers", "id", paper_id, False, pdf_path=path)

    def set_keywords(self, paper_id: str, keywords: str) -> None:
        self._change("papers", "id", paper_id, keywords=keywords[:MAX_KEYWORDS])

    def set_status(self, paper_id: str, status: str) -> None:
        if status not in PAPER_STATUS:
            raise Validation(f"status: {status}")
        self._change("papers", "id", paper_id, status=status)

    def set_reading_status(self, paper_id: str, status: str) -> None:
        if status not in READING_STATUS:
            raise Validation(f"reading status: {status}")
        self._change("papers", "id", paper_id, reading_status=status)

    def set_rating(self, paper_id: str, rating: int | None) -> None:
        if rating is not None and not (isinstance(rating, int) and 1 <= rating <= 5):
            raise Validation(f"rating: {rating}")
        self._change("papers", "id", paper_id, rating=F.lit(rating))

    def insert_citations(self, edges: DataFrame) -> int:
        return self.revise("citations", lambda rows: graph.new_edges(rows, edges))

    def label_citations(self, labels: DataFrame) -> int:
        return self.revise("citations", lambda rows: graph.label_edges(rows, labels).where("changed").drop("changed"))

    def counts(self) -> Counts:
        """Counts of the whole library, brought up to date."""
        return Counts(self)

    def get_paper(self, paper_id: str) -> DataFrame:
        return scans.get(self.read("papers"), "id", paper_id)

    def search(self, query: str, k: int = 20) -> DataFrame:
        """By the index if one was built, else by all rows; both rank alike. Of the tables the index reads the hits alone."""
        papers = self.read("papers")
        if search.query_terms(query) and self.refresh_index():
            meta = self.index("papers").top(query, k)
            known = lambda rows: rows.join(papers.select("id"), "id", "left_semi").join(meta.select("id"), "id", "left_anti")
            body = self.index("bodies").top(query, k, known)
            hits = meta.withColumn("tier", F.lit(0)).unionByName(body.withColumn("tier", F.lit(1))).select("id", "tier", "rank").orderBy("tier", "rank", "id").limit(k)
        else:
            hits = search.search_merged(papers, self.read("bodies"), query, k)
        return hits.join(papers, "id").orderBy("tier", "rank", "id")

    def evidence(self, query: str, k: int = 10, paper_id: str | None = None) -> DataFrame:
        papers, bodies, ranks = self.read("papers"), self.read("bodies"), None
        if search.query_terms(query) and self.refresh_index():
            known = papers.select("id") if paper_id is None else papers.where(F.col("id") == paper_id).select("id")
            ranks = self.index("bodies").top(query, k, lambda rows: rows.join(known, "id", "left_semi"))
        return search.evidence(papers, bodies, query, k, paper_id, ranks)

    def index_is_fresh(self) -> bool:
        return all((state := self.index(t).state()) is not None and not self._unseen(t, state, None) for t in SEARCHED)

    def _unseen(self, table: str, state: dict, at: int | None) -> list[dict]:
        """The batches that the index doesn't know of."""
        return [x for x in self.log(table).live(at) if max(x["order"], x.get("whole", 0)) > state["follows"]]

    def _rows_to_index(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(SEARCHED[table][0], "id")

    def rebuild_index(self) -> None:
        """Builds the index of all rows. From then on it follows each write by a segment of what the write changed."""
        for table in SEARCHED:
            at = self.log(table).version()
            self.index(table).build(self._rows_to_index(table, self.read(table, at)), at)

    def refresh_index(self) -> bool:
        """Brings an index that was built up to date; false if there is none."""
        if any(self.index(t).state() is None for t in SEARCHED):
            return False
        for table in SEARCHED:
            self._follow(table)
        return True

    def _follow(self, table: str) -> None:
        if table not in SEARCHED:
            return
        index = self.index(table)
        while (state := index.state()) is not None:
            at = self.log(table).version()
            unseen, since = self._unseen(table, state, at), state["follows"]
            if not unseen:
                return
            try:
                if any(x.get("whole", 0) > since for x in unseen):  # compacted before the index saw it
                    index.build(self._rows_to_index(table, self.read(table, at)), at)
                else:
                    changed = self._rows_to_index(table, self._latest(table, at, since))
                    former = self._rows_to_index(table, self._present(table, self._latest(table, at, upto=since)))
                    index.add(changed.where("not _deleted"), former.join(changed.select("id"), "id", "left_semi"), changed.select("id"), at)
            except Conflict:  # another writer's index segment came first
                continue

    def reports(self) -> DataFrame:
        return self.read("reports").withColumn("sections", T.report_sections(F.col("content")))
