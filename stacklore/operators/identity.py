"""Which incoming records the library already has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import Scratch


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the match keys. The title counts only where neither identifier nor path is given, even if they are blank."""
    return rows.withColumns({"k_doi": T.normalize_doi(F.col("doi")), "k_path": F.col("pdf_path"), "k_title": F.when(F.col("doi").isNull() & F.col("pdf_path").isNull(), T.blank_to_null(T.normalize_title(F.col("title"))))})


def _first(rows: DataFrame, key, name: str) -> DataFrame:
    """The earliest row of each key, so that a join can't multiply rows."""
    return rows.select(key.alias(f"k_{name}"), "id", "seq").where(F.col(f"k_{name}").isNotNull()).groupBy(f"k_{name}").agg(F.min_by("id", F.struct("seq", "id")).alias(f"by_{name}"), F.min("seq").alias(f"seq_{name}"))


def _around(key, *ids: str):
    """The key, or for rows without one a value of their own that no key equals, so that they don't share one task."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*ids).cast("string")))


def _library_matches(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """incoming with its keys and the library's earliest row by each: by_doi, by_path, by_title. Three equi-joins, no OR."""
    out = keyed(incoming)
    for name, key in (("doi", T.normalize_doi(F.col("doi"))), ("path", F.col("pdf_path")), ("title", T.blank_to_null(T.normalize_title(F.col("title"))))):
        first = _first(library, key, name).withColumnRenamed(f"k_{name}", "__k").drop(f"seq_{name}")
        out = out.withColumn("__k", _around(F.col(f"k_{name}"), "id", "seq")).join(first, "__k", "left").drop("__k")
    return out


def resolve(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """incoming with matched_id and matched_by: identifier, then path, then title."""
    out = _library_matches(incoming, library)
    by = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_path").isNotNull(), "path").when(F.col("by_title").isNotNull(), "title")
    return out.select(*incoming.columns, F.coalesce("by_doi", "by_path", "by_title").alias("matched_id"), by.alias("matched_by"))


KINDS = ("doi", "path", "title")


def _long(rows: DataFrame, **keys: str) -> DataFrame:
    """id, at, kind, key: one row for each key that a row has."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key")) for kind, column in keys.items()]))
    return rows.select("id", F.struct("seq", "id").alias("at"), each.alias("k")).select("id", "at", "k.*").where("key is not null")


#: Rounds before chains are looked for.
PLAIN = 3


def _chains(state: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """id, known of the rows that depend on a settled row through rows which wait for one other each: such a row is new if
    the row it waits for isn't. Pointers double, so a chain of n rows takes log2(n) joins."""
    links = state.where("not hit and waits and not many and low = high").select("id", F.col("low.id").alias("to"), F.lit(True).alias("flip"))
    links, n = scratch.save(links, f"links{k}_0"), 0
    while True:
        on = links.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("flip").alias("again"))
        joined = links.join(on, "to", "left")
        if joined.where("next is not null").isEmpty():
            break
        n += 1
        links = scratch.save(joined.select("id", F.coalesce("next", "to").alias("to"), F.when(F.col("next").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("again")).alias("flip")), f"links{k}_{n}")
    ends = state.where("hit or not waits").select(F.col("id").alias("to"), "hit")
    return links.join(ends, "to").select("id", (F.col("hit") != F.col("flip")).alias("known"))


def resolve_batch(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """As if the rows came one by one, in order of seq, ids being unique: a row also matches an earlier row of the batch
    that was itself inserted, and an identifier met there outranks a path or title met in the library. Adds is_new.

    Rounds to a fixed point. In each, a key has one row, its first inserted and its first undecided offer: a row with an
    earlier inserted offer is a duplicate, one that waits for no earlier undecided offer is new. So no round joins a
    row to more than its three keys. What is open after PLAIN rounds may be chains, in which each row waits for one other:
    these are contracted by ``_chains``. Rounds are written to the shared folder."""
    scratch = Scratch(incoming.sparkSession)
    rows = scratch.save(_library_matches(incoming, library).withColumn("own_title", T.blank_to_null(T.normalize_title(F.col("title")))), "rows")
    undecided = scratch.save(rows.where("by_doi is null and by_path is null and by_title is null").select("id", "seq", *(f"k_{x}" for x in KINDS), "own_title"), "open0")
    inserted, k = scratch.save(undecided.where("false"), "inserted0"), 0
    offered = lambda offers: _long(offers, doi="k_doi", path="k_path", title="own_title")
    first = lambda offers, name: offered(offers).groupBy("kind", "key").agg(F.min("at").alias(name))
    while not undecided.isEmpty():
        waiting = first(undecided, "waiting")
        asked = _long(undecided, doi="k_doi", path="k_path", title="k_title").join(waiting, ["kind", "key"], "left").join(first(inserted, "stored"), ["kind", "key"], "left")
        earlier = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
        told = [F.bool_or(earlier("stored")).alias("hit"), F.bool_or(earlier("waiting")).alias("waits")]
        if k >= PLAIN:
            second = offered(undecided).join(waiting, ["kind", "key"]).where("at > waiting").groupBy("kind", "key").agg(F.min("at").alias("second"))
            asked = asked.join(second, ["kind", "key"], "left")
            one = F.when(earlier("waiting"), F.col("waiting"))
            told += [F.bool_or(earlier("second")).alias("many"), F.min(one).alias("low"), F.max(one).alias("high")]
        told = asked.groupBy("id").agg(*told)
        no = F.lit(False)
        state = scratch.save(undecided.join(told, "id", "left").withColumns({"hit": F.coalesce("hit", no), "waits": F.coalesce("waits", no)}), f"state{k}")
        settled = state.where("hit or not waits").select("id", F.col("hit").alias("known"))
        if k >= PLAIN:
            settled = settled.unionByName(_chains(state, scratch, k))
        k += 1
        mine = [c for c in undecided.columns]
        done = scratch.save(settled, f"settled{k}")
        inserted = scratch.save(inserted.unionByName(undecided.join(done.where("not known"), "id").select(*mine)), f"inserted{k}")
        undecided = scratch.save(undecided.join(done, "id", "left_anti").select(*mine), f"open{k}")
        scratch.keep("rows", f"inserted{k}", f"open{k}")
    offers = scratch.save(first(inserted, "stored"), "offers")
    out = rows
    for kind in KINDS:
        mine = offers.where(F.col("kind") == kind).select(F.col("key").alias("__k"), F.col("stored").alias(f"in_{kind}"))
        out = out.withColumn("__k", _around(F.col(f"k_{kind}"), "id", "seq")).join(mine, "__k", "left").drop("__k")
        earlier = F.col(f"in_{kind}") < F.struct("seq", "id")
        out = out.withColumn(f"any_{kind}", F.coalesce(f"by_{kind}", F.when(earlier, F.col(f"in_{kind}.id"))))
    by = F.when(F.col("any_doi").isNotNull(), "doi").when(F.col("any_path").isNotNull(), "path").when(F.col("any_title").isNotNull(), "title")
    matched = F.coalesce(*(f"any_{x}" for x in KINDS))
    scratch.keep("rows", "offers")
    return out.select(*incoming.columns, matched.alias("matched_id"), by.alias("matched_by"), matched.isNull().alias("is_new"))


def link_related(related: DataFrame, library: DataFrame) -> DataFrame:
    """related (source_id, openalex_id, doi) with the library's paper: by OpenAlex id, then by identifier. A paper isn't
    related to itself."""
    works = _first(library, T.work_id(F.col("openalex_id")), "work")
    dois = _first(library, T.normalize_doi(F.col("doi")), "doi")
    out = related.withColumns({"k_work": T.work_id(F.col("openalex_id")), "k_doi": T.normalize_doi(F.col("doi"))}).join(works, "k_work", "left").join(dois, "k_doi", "left")
    return out.select(*related.columns, F.coalesce("by_work", "by_doi").alias("paper_id")).where("paper_id is not null and paper_id != source_id")
