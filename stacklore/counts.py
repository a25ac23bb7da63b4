"""Counts of a library that follow its log.

Each count is a sum over rows, so it changes by what the changed rows count now less what they counted before; batches
that were counted once aren't read again for their own sake. The counts themselves are a commit of a log of their own.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commits import CommitLog, Conflict
from .functions import text as T
from .schema import PAPER_STATUS, READING_STATUS, TABLES

if TYPE_CHECKING:
    from .library import Library

COUNTED = ("papers", "topics", "gaps", "reports", "citations")


def sums(table: str) -> dict[str, Column]:
    """What is counted of a table's rows, by name."""
    out = {table: F.count("*")}
    if table == "papers":
        out |= {"papers_read": F.count_if(F.col("reading_status") == "completed"), "queued": F.count_if(F.col("reading_status") == "queued"), "rated": F.count("rating")}
        for column, stages in (("status", PAPER_STATUS), ("reading_status", READING_STATUS)):
            out |= {f"{column}:{stage}": F.count_if(T.one_of(F.col(column), stages) == stage) for stage in stages}
    if table == "citations":
        out |= {"labelled": F.count_if(F.col("context") != ""), "unlabelled": F.count_if(F.col("context") == "")}
    return out


class Counts:
    def __init__(self, library: Library) -> None:
        self.library, self.log = library, CommitLog(library.spark, f"{library.root}/counts")
        self.values: dict[str, int] = {}
        for table in COUNTED:
            self.values |= self._follow(table)

    def _follow(self, table: str) -> dict[str, int]:
        """The counts of one table at its present version. A table that was compacted before its last batches were counted
        is counted as a whole."""
        log = CommitLog(self.library.spark, f"{self.log.root}/{table}")
        while True:
            version = log.version()
            state = log._entry(version) if version else {"follows": 0, "values": dict.fromkeys(sums(table), 0)}
            at, since = self.library.log(table).version(), state["follows"]
            unseen = [x for x in self.library.log(table).live(at) if max(x["order"], x.get("whole", 0)) > since]
            if not unseen:
                return state["values"]
            if any(x.get("whole", 0) > since for x in unseen) or not since:
                values = self._sum(table, self.library.read(table, at))
            else:
                changed = self.library._latest(table, at, since)
                keys = changed.select(*TABLES[table][1])
                former = self.library._present(table, self.library._latest(table, at, upto=since)).join(keys, TABLES[table][1], "left_semi")
                now, before = self._sum(table, changed.where("not _deleted")), self._sum(table, former)
                values = {k: v + now[k] - before[k] for k, v in state["values"].items()}
            try:
                log.commit(None, version, follows=at, values=values)
                return values
            except Conflict:
                continue

    def _sum(self, table: str, rows: DataFrame) -> dict[str, int]:
        return rows.agg(*[c.alias(name) for name, c in sums(table).items()]).first().asDict()

    def overview(self) -> DataFrame:
        """One row, as ``stats.overview`` gives."""
        names = ("papers", "papers_read", "queued", "rated", "topics", "gaps", "reports")
        return self.library.spark.createDataFrame([tuple(self.values[n] for n in names)], ", ".join(f"{n} long" for n in names))

    def funnel(self, column: str) -> DataFrame:
        """A row for each stage, as ``stats.funnel`` gives."""
        stages = PAPER_STATUS if column == "status" else READING_STATUS
        return self.library.spark.createDataFrame([(i, x, self.values[f"{column}:{x}"]) for i, x in enumerate(stages)], "position int, stage string, n long")

    def edges(self) -> DataFrame:
        """One row, as ``graph.label_counts`` gives."""
        return self.library.spark.createDataFrame([tuple(self.values[n] for n in ("citations", "labelled", "unlabelled"))], "edges long, labelled long, unlabelled long")
