"""Continuous import of files that land in a folder, an extension: records are resolved and stored once.

Files of one micro-batch are known by the engine's checkpoint. If a batch is run again, after its rows were committed and
before the checkpoint was, its records find themselves in the library, by ids that are digests of what they are made of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..errors import Validation
from ..library import Library
from ..operators import identity
from ..scratch import Scratch
from ..sources import atom, bibtex, json_sources

#: What the files of each kind of source hold, and how they end.
READERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "bibliography": ("json", lambda d: json_sources.bibliography(d).drop("file")),
    "bibtex": ("bib,bibtex", lambda d: bibtex.parse(d).where("error is null").drop("error", "file")),
    "openalex": ("json", lambda d: json_sources.openalex(d).drop("file")),
    "europe_pmc": ("json", lambda d: json_sources.europe_pmc(d).drop("file")),
    "preprints": ("json", lambda d: json_sources.europe_pmc(d, True).drop("file")),
    "semantic_scholar": ("json", lambda d: json_sources.semantic_scholar(d)),
    "feed": ("xml,atom", lambda d: atom.papers(atom.entries(d))),
}


def _reader(kind: str) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    if kind not in READERS:
        raise Validation(f"no such source: {kind}")
    return READERS[kind]


def extension(kind: str) -> str:
    return _reader(kind)[0]


def records(kind: str, documents: DataFrame) -> DataFrame:
    """Papers of documents (file, content) of one kind."""
    return _reader(kind)[1](documents)


def store_new(library: Library, documents: DataFrame, kind: str = "bibliography") -> int:
    """Adds the records of the documents which the library lacks, also as against each other. Ids are digests of the
    record, so that a repeated batch changes nothing, and of records that match each other the one of the least digest is
    stored, in whatever order the files of a batch came."""
    rows = records(kind, documents)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in ("title", "doi", "arxiv_id", "url", "year")]
    rows = rows.withColumn("id", F.sha2(F.concat_ws("\x01", *fields), 256)).dropDuplicates(["id"])
    fill = {c: F.lit(None).cast("string") for c in ("doi", "pdf_path") if c not in rows.columns}
    rows = rows.withColumns(fill | {"seq": F.conv(F.substring("id", 1, 15), 16, 10).cast("long")})
    scratch = Scratch(library.spark)
    rows = scratch.save(rows, "rows")
    resolved = identity.resolve_batch(rows, library.read("papers").withColumn("seq", F.lit(0).cast("long")))
    new = scratch.save(resolved.where("is_new").drop("seq", "matched_id", "matched_by", "is_new"), "new")
    n = new.count()
    if n:
        library.upsert("papers", new)
    scratch.keep()
    return n


def watch(library: Library, folder: str, checkpoint: str, kind: str = "bibliography") -> StreamingQuery:
    """Stores what lies in a folder and hasn't been stored, then ends; run it again for what lands later."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extension(kind).split(",")) + "}"
    stream = library.spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(folder)
    rows = stream.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return rows.writeStream.foreachBatch(lambda batch, _: store_new(library, batch, kind) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
