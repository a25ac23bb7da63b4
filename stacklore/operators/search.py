"""Full-text search: substring phrases of three or more characters, BM25, merged tiers, located evidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, FLOOR = 1.2, 0.75, 1e-6
FIELDS = ("title", "abstract_text", "notes", "tags", "keywords")
#: Longest window of a snippet in characters, and how many of them may stand before its first match.
SNIPPET, LEAD = 34, 8


def query_terms(query: str) -> list[str]:
    """Phrases of a query: parts between white space without quotes. Parts under three characters can't be searched."""
    parts = [x.replace('"', "").lower() for x in query.split()]
    return [x for x in parts if len(x) >= 3]


def occurrences(column: Column, term: str) -> Column:
    """How often the term stands in the column, overlaps included. ``column`` is in lower case."""
    if any(term.startswith(term[i:]) for i in range(1, len(term))):
        return F.regexp_count(column, F.lit(f"(?={re.escape(term)})"))
    return (F.length(column) - F.length(F.replace(column, F.lit(term), F.lit("")))) / F.lit(len(term))


def _lowered(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    kinds = dict(rows.dtypes)
    text = lambda f: F.to_json(f) if kinds[f].startswith("array") else F.col(f)
    return rows.withColumns({f"__{i}": F.lower(F.coalesce(text(f), F.lit(""))) for i, f in enumerate(fields)})


def _size(columns: list[Column]) -> Column:
    return reduce(Column.__add__, [F.greatest(F.length(c) - 2, F.lit(0)) for c in columns])


def searched_text(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """id, text, size: the searched columns in lower case, apart from each other, and their size in trigrams."""
    columns = [F.col(f"__{i}") for i in range(len(fields))]
    return _lowered(rows, fields).select("id", F.concat_ws("\x00", *columns).alias("text"), _size(columns).alias("size"))


def ranked(rows: DataFrame, query: str, fields: tuple[str, ...] = FIELDS, totals: DataFrame | None = None) -> DataFrame:
    """Rows that hold all terms, with ``rank``: BM25 with smaller for better. Statistics are one aggregated row. If
    ``rows`` are only those that hold a term, ``totals`` (n, mean) are the number of all rows and their mean size."""
    terms = query_terms(query)
    if not terms:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    low = _lowered(rows, fields)
    columns = [F.col(f"__{i}") for i in range(len(fields))]
    size = _size(columns)
    holds = [reduce(Column.__or__, [c.contains(t) for c in columns]) for t in terms]
    stats = low.agg(F.count("*").alias("__n"), F.avg(size).alias("__avg"), *[F.count_if(h).alias(f"__d{i}") for i, h in enumerate(holds)])
    if totals is not None:
        stats = stats.drop("__n", "__avg").join(F.broadcast(totals.select(F.col("n").alias("__n"), F.col("mean").alias("__avg"))))
    found = low.where(reduce(Column.__and__, holds)).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f = reduce(Column.__add__, [occurrences(c, t) for c in columns]).cast("double")
        idf = F.log((F.col("__n") - F.col(f"__d{i}") + 0.5) / (F.col(f"__d{i}") + 0.5))
        score = score + F.when(idf <= 0, FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col("__avg")))
    return found.withColumn("rank", -score).select(*rows.columns, "rank")


def top(rows: DataFrame, query: str, k: int, key: str = "id", fields: tuple[str, ...] = FIELDS, totals: DataFrame | None = None) -> DataFrame:
    return ranked(rows, query, fields, totals).orderBy("rank", key).limit(k)


def search_merged(papers: DataFrame, bodies: DataFrame, query: str, k: int, of_papers: DataFrame | None = None, of_bodies: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Hits in metadata by rank, then papers hit only in their bodies by rank, k in all: id, tier, rank. Where the tables
    are only what an index found, it gives their totals and the ids of all papers."""
    meta = top(papers, query, k, totals=of_papers).select("id", F.lit(0).alias("tier"), "rank")
    body = ranked(bodies, query, ("body",), of_bodies).select(F.col("paper_id").alias("id"), F.lit(1).alias("tier"), "rank")
    body = body.join(papers.select("id") if known is None else known, "id", "left_semi").join(meta.select("id"), "id", "left_anti").orderBy("rank", "id").limit(k)
    return meta.unionByName(body).orderBy("tier", "rank", "id").limit(k)


def matches(rows: DataFrame, terms: list[str]) -> DataFrame:
    """paper_id, places: all occurrences (at, end, term) of the terms in bodies, in order. Bodies are split before each
    occurrence, and a window sums up the lengths of the pieces, so the work is in proportion to the body."""
    parts = F.array(*[F.struct(F.lit(i).alias("term"), F.lit(len(t)).alias("length"), F.split("low", f"(?={re.escape(t)})", -1).alias("pieces"), F.col("low").startswith(t).alias("at_once")) for i, t in enumerate(terms)])
    each = rows.select("paper_id", F.lower("body").alias("low")).select("paper_id", F.inline(parts))
    each = each.select("paper_id", "term", "length", "at_once", F.posexplode("pieces").alias("n", "piece"))
    order = Window.partitionBy("paper_id", "term").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)).cast("int")
    each = each.withColumn("at", at).where("n > 0 or at_once")
    place = F.struct("at", (F.col("at") + F.least("length", F.lit(SNIPPET))).alias("end"), "term")
    return each.groupBy("paper_id").agg(F.array_sort(F.collect_list(place)).alias("places"))


def best_window(places: Column, terms: int) -> Column:
    """Where the window of SNIPPET characters begins, always at a match, that shows most different terms, then most
    matches, then is first. Two pointers pass over the matches, which enter by their ends and leave by their beginnings;
    ``seen`` counts the matches of each term between them."""
    ends = F.array_sort(F.transform(places, lambda m: F.struct(m["end"].alias("end"), m["at"].alias("at"), m["term"].alias("term"))))
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array_repeat(F.lit(0), terms).alias("seen"), F.lit(0).alias("kinds"), F.lit(0).alias("n"), F.lit(-1).alias("at"))

    def step(s: Column, both: Column) -> Column:
        left, right, seen = F.get(both["places"], s["i"]), F.get(both["ends"], s["j"]), s["seen"]
        enters = F.coalesce(right["end"] <= left["at"] + SNIPPET, F.lit(False))
        kinds, n = F.aggregate(seen, F.lit(0), lambda a, x: a + (x > 0).cast("int")), s["j"] - s["i"]
        better = ~enters & ((kinds > s["kinds"]) | ((kinds == s["kinds"]) & (n > s["n"])))
        changed = F.transform(seen, lambda x, k: x + F.when(enters & (k == right["term"]), 1).when(~enters & (k == left["term"]), -1).otherwise(0))
        take = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(
            (s["i"] + (~enters).cast("int")).alias("i"), (s["j"] + enters.cast("int")).alias("j"), changed.alias("seen"),
            take(kinds, s["kinds"]).alias("kinds"), take(n, s["n"]).alias("n"), take(left["at"], s["at"]).alias("at"),
        )

    steps = F.sequence(F.lit(1), F.size(places) * 2)
    both = F.array(F.struct(places.alias("places"), ends.alias("ends")))
    return F.transform(both, lambda b: F.aggregate(steps, state, lambda s, _: step(s, b), lambda s: s["at"]))[0]


def evidence(papers: DataFrame, bodies: DataFrame, query: str, k: int, paper_id: str | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """Best bodies with a snippet and the section and page of the first match shown in it. A paper's scope comes before the
    limit; snippets are made for the k rows alone, from ``ranks`` (id, rank) if an index has found them. A few characters
    before the window's first match are shown where they don't push a counted match out and hold no match themselves."""
    terms = query_terms(query)
    if ranks is None:
        whole = ranked(bodies, query, ("body",))
        if paper_id is not None:
            whole = whole.where(F.col("paper_id") == paper_id)
    else:
        whole = bodies.join(ranks.withColumnRenamed("id", "paper_id"), "paper_id")
    hits = whole.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id").orderBy("rank", "paper_id").limit(k)
    low = F.lower("body")
    hits = hits.withColumn("shown", F.when(F.length(low) == F.length("body"), F.col("body")).otherwise(low))
    hits = hits.join(matches(hits, terms or [" "]), "paper_id").withColumn("first", best_window(F.col("places"), max(len(terms), 1)))
    inside = F.filter("places", lambda m: (m["at"] >= F.col("first")) & (m["end"] <= F.col("first") + SNIPPET))
    room = SNIPPET + F.col("first") - F.array_max(F.transform(inside, lambda m: m["end"]))
    former = F.array_max(F.transform(F.filter("places", lambda m: m["at"] < F.col("first")), lambda m: m["at"]))
    begin = F.col("first") - F.least(F.lit(LEAD), F.col("first"), room, F.col("first") - F.coalesce(former, F.lit(-1)) - 1)
    any_term = "|".join(re.escape(t[:SNIPPET]) for t in sorted(terms, key=len, reverse=True)) or "(?!)"
    marked = F.regexp_replace(F.substring("shown", begin + 1, F.lit(SNIPPET)), f"(?iu){any_term}", "[$0]")
    snippet = F.concat(F.when(begin > 0, "…").otherwise(""), marked, F.when(begin + SNIPPET < F.length("shown"), "…").otherwise(""))
    before = F.substring("body", F.lit(1), F.col("first"))
    return hits.select("paper_id", "title", snippet.alias("snippet"), T.anchor_section(before).alias("section"), T.anchor_page(before).alias("page"), F.round("rank", 6).alias("rank"))
