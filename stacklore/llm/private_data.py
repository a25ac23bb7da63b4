"""Personal data: known shapes, and terms that give protected entities away.

DataFrame operations only. A match's place is found by setting marks around matches and adding up the lengths of the
pieces between marks; marks that stand in a text are first replaced by another code point that no shape can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Scratch, keyed_join, let, read_table, text_or_empty

OPEN, CLOSE, PLAIN = "﷐", "﷑", "﷒"
# The shapes. Possessive loops and the look behind change no match; they keep matching linear.
SHAPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{10}", "phone": r"\+[0-9]"}
KINDS = ("email", "ip", "card", "phone", "term")
#: Distinct texts that have to show an entity and a term.
SUPPORT = 3
#: Share of an entity's information which a term may give: over the first it is generalised, over the second removed.
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"[\p{L}][\p{L}\p{M}\p{N}_'-]*+"

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """Text between and inside matches by turns, the first piece before the first match."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of all matches for which ``keep(match)`` holds."""

    def part(pieces: Column, at: Column) -> Column:
        def more(state: Column, piece: Column) -> Column:
            inside = state["n"] % 2 == 1
            stop = state["at"] + F.length(piece)
            span = F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), stop.alias("end"), piece.alias("value"))
            return F.struct(stop.alias("at"), (state["n"] + 1).alias("n"), F.when(inside & keep(piece), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

        begin = F.struct(at.alias("at"), F.lit(0).alias("n"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(pieces, begin, more, lambda s: s["found"])

    def spans(pieces: Column) -> Column:
        # parts of about as many pieces as there are parts, an even number, so that no list grows with all matches
        n = F.size(pieces)
        size = (2 * F.ceil(F.sqrt(n) / 2)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.slice(pieces, k * size + 1, size))

        def joined(parts: Column) -> Column:
            lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x)))
            before = lambda ls, k: F.aggregate(F.slice(ls, F.lit(1), k), F.lit(0), lambda a, x: a + x)
            return let(lengths, lambda ls: F.flatten(F.transform(parts, lambda p, k: part(p, before(ls, k)))))

        return let(parts, joined)

    return let(_pieces(text, pattern), spans)


def _luhn(value: Column) -> Column:
    def check(digits: Column) -> Column:
        n = F.length(digits)
        total = F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda a, i: a + let(F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
        )
        return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(value, "[^0-9]", ""), check)


def _valid(kind: str):
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (q.try_cast("int") <= 255))),
        "card": _luhn,
        "phone": lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """All base spans of a text in order: start, kind (place in KINDS), end, value."""
    clean = F.translate(text, OPEN + CLOSE, PLAIN * 2)
    none = F.array().cast(SPAN)
    found = [F.when(text.rlike(HINTS[k]), _matches(clean, SHAPES[k], i, _valid(k))).otherwise(none) for i, k in enumerate(SHAPES)]
    return F.sort_array(F.concat(*found))


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, base: Column) -> Column:
    """The text with its entities and stray marks blanked, at the same length."""

    def more(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        blank = F.repeat(F.lit(PLAIN), s["end"] - F.greatest(state["at"], s["start"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], before, blank).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    blanked = F.aggregate(base, begin, more, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.translate(F.when(F.size(base) > 0, blanked).otherwise(text), OPEN + CLOSE, PLAIN * 2)


def terms_of(words: Column) -> Column:
    """The distinct terms of a masked text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(words, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """term, share: terms whose pointwise mutual information with an entity is at least GENERALISE of what naming the
    entity itself would tell, counted over all rows and whole texts, where SUPPORT distinct texts show the pair. share
    is the largest over the entities.

    A text's entities and terms are distinct and equal texts are one row with a weight, so all counts are sums that are
    taken map-side before they are shuffled. Entities in fewer than SUPPORT texts have no such pair and go first; of all
    words of all texts only those of such pairs are counted."""
    n = kept.count()
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    held = kept.where(F.size("base") > 0).select("key", F.md5(F.encode("words", "UTF-8")).alias("digest"), entities.alias("entities"), terms_of(F.col("words")).alias("terms"))
    held = held.groupBy("key", "digest", F.md5(F.encode(F.array_join("entities", "\n"), "UTF-8"))).agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    texts = scratch.save(held.select("key", "copies", "entities", "terms"), "texts")
    each = texts.select(F.explode("entities").alias("entity"), "key", "copies", "terms")
    known = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"))
    known = scratch.save(known.where((F.col("texts") >= SUPPORT) & (F.col("n_entity") < n)).drop("texts"), "entities")
    pairs = keyed_join(each, known, ["entity"]).select("entity", "n_entity", "copies", F.explode("terms").alias("term"))
    both = pairs.groupBy("entity", "n_entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    both = scratch.save(both, "both")
    asked = scratch.save(both.select("term").distinct(), "asked")
    in_texts = keyed_join(kept.select("copy", F.explode(terms_of(F.col("words"))).alias("term")), asked, ["term"]).groupBy("term").agg(F.count("*").alias("n_term"))
    rows = F.lit(float(n))
    share = F.log(F.least(rows * F.col("n_both") / F.col("n_entity") / F.col("n_term"), rows / F.col("n_entity"))) / F.log(rows / F.col("n_entity"))
    found = both.join(in_texts, "term").withColumn("share", share).where(F.col("share") >= GENERALISE)
    return found.groupBy("term").agg(F.max("share").alias("share"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans for each row: base holds the base spans, spans these and the terms that give them away.

    A term that gives an entity away is marked at each of its places in all texts, those without the entity too. Null
    text counts as empty; repeated rows and null ids each keep their own row; an empty table gives none; other columns
    are not read. An entity or term in a third of all rows is summed map-side before it is shuffled; up to
    MAX_BROADCAST_ROWS terms are looked up as sets in the plan, more are joined with the rows by salted keys."""
    scratch = Scratch(docs.sparkSession)
    text = docs.select("doc_id", text_or_empty().alias("text"))
    found = text.withColumn("base", base_spans(F.col("text")))
    key, copy = F.xxhash64("text"), F.expr("uuid()")
    kept = scratch.save(found.select("doc_id", copy.alias("copy"), key.alias("key"), "base", masked(F.col("text"), F.col("base")).alias("words")), "base")
    telling = scratch.save(disclosing(kept, scratch), "terms")
    if telling.count() <= MAX_BROADCAST_ROWS:  # sets in the plan, so that neither texts nor lists are moved
        known = telling.collect()
        given, lost = [r["term"] for r in known], [r["term"] for r in known if r["share"] >= REMOVE]
        joined = kept.withColumn("terms", F.filter(terms_of(F.col("words")), lambda x: x.isin(given)))
        joined = joined.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")))
        removed = F.filter("terms", lambda x: x.isin(lost))
        scratch.keep("base")
    else:
        told = keyed_join(kept.select("copy", F.explode(terms_of(F.col("words"))).alias("term")), telling, ["term"])
        lost = F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term")))
        more = scratch.save(told.groupBy("copy").agg(F.collect_set("term").alias("terms"), lost.alias("removed")), "told")
        scratch.keep("base", "told")
        joined, removed = kept.join(more, "copy", "left"), F.col("removed")
    joined = joined.withColumn("removed", removed)
    places = _matches(F.col("words"), TERM, 4, lambda x: F.array_contains("terms", F.lower(x)))
    general = F.transform(places, lambda s: s.withField("value", F.when(F.array_contains("removed", F.lower(s["value"])), "").otherwise(F.lit("[term]"))))
    terms = F.when(F.col("terms").isNotNull(), general).otherwise(F.array().cast(SPAN))
    return joined.select("doc_id", "base", F.sort_array(F.concat("base", terms)).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced: entities by their kind in brackets, terms by their general form or nothing."""
    names = F.array(*map(F.lit, KINDS))

    def more(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == 4, s["value"]).otherwise(F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]")))
        inside = s["start"] < state["at"]
        part = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(part).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, more, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    any_hit = (F.size("base") > 0).cast("int").alias("has_personal_data")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(SHAPES)], any_hit, F.sha2(F.encode(shown(F.col("base")), "UTF-8"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
