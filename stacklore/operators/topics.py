"""Topic trees, briefs, budgeted contexts, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Validation
from ..functions import text as T
from ..schema import GAP_CHARS, GAP_TOKENS, KEYWORD_TOKENS, REPORT_TOKENS
from ..scratch import Scratch


def paper_order() -> list[Column]:
    """A topic's papers from the most relevant to the least."""
    return [F.desc("relevance"), F.desc("created_at"), F.asc("paper_id")]



def with_depth(topics: DataFrame) -> DataFrame:
    """depth_by_parent: one more than the parent's stored depth, zero at roots."""
    parents = topics.select(F.col("id").alias("parent_topic_id"), F.col("depth").alias("__up"))
    return topics.join(parents, "parent_topic_id", "left").withColumn("depth_by_parent", F.coalesce(F.col("__up") + 1, F.lit(0))).drop("__up")


def ancestors(topics: DataFrame) -> DataFrame:
    """topic, ancestor, distance for the whole tree, by doubling: a round joins each topic's pairs to those of the topic
    that lies as far up as the pairs reach, so a tree of depth d takes about log2(d) rounds. Parents that aren't topics
    are ancestors without further ones. A cycle is an error: its topics still lie above themselves when paths are longer
    than there are topics."""
    scratch, total, k = Scratch(topics.sparkSession), topics.count(), 0
    up = topics.where("parent_topic_id is not null").select(F.col("id").alias("topic"), F.col("parent_topic_id").alias("ancestor"))
    jump = scratch.save(up, "jump0")  # the ancestor at distance 2 ** k
    pairs = scratch.save(topics.select(F.col("id").alias("topic"), F.col("id").alias("ancestor"), F.lit(0).alias("distance")), "pairs0")  # at less than 2 ** k
    strangers = jump.select(F.col("ancestor").alias("topic")).distinct().join(pairs.select("topic"), "topic", "left_anti")
    pairs = pairs.unionByName(strangers.select("topic", F.col("topic").alias("ancestor"), F.lit(0).alias("distance")))
    while not jump.isEmpty():
        if 1 << k > total:
            raise Validation("topics are their own ancestors: " + ", ".join(r["topic"] for r in jump.select("topic").orderBy("topic").limit(5).collect()))
        above = jump.select(F.col("topic").alias("below"), F.col("ancestor").alias("topic"))
        far = above.join(pairs, "topic").select(F.col("below").alias("topic"), "ancestor", (F.col("distance") + (1 << k)).alias("distance"))
        k += 1
        pairs = scratch.save(pairs.unionByName(far), f"pairs{k}")
        jump = scratch.save(above.join(jump, "topic").select(F.col("below").alias("topic"), "ancestor"), f"jump{k}")
        scratch.keep(f"pairs{k}", f"jump{k}")
    return pairs.join(topics.select(F.col("id").alias("topic")), "topic", "left_semi").select("topic", "ancestor", "distance")


def moved(closure: DataFrame, moves: DataFrame) -> DataFrame:
    """The ancestors after topics got another parent (topic, parent; null for none), from the ancestors before: the pairs
    between a moved subtree and what was above it go, those with what is above the new parent come. Moved subtrees must
    not lie in each other; a new parent inside its own subtree is an error."""
    inside = closure.join(moves.select(F.col("topic").alias("ancestor")), "ancestor").select(F.col("ancestor").alias("head"), "topic", F.col("distance").alias("below"))
    bad = inside.join(moves, (F.col("head") == moves["topic"]) & (inside["topic"] == F.col("parent"))).limit(1).collect()
    if bad:
        raise Validation(f"topic under itself: {bad[0]['head']}")
    old = inside.select("head", "topic").join(closure.where("distance > 0"), "topic").join(inside.select("head", F.col("topic").alias("ancestor")), ["head", "ancestor"], "left_anti").select("topic", "ancestor")
    over = moves.where("parent is not null").select(F.col("topic").alias("head"), F.col("parent").alias("topic")).join(closure, "topic").select("head", "ancestor", (F.col("distance") + 1).alias("above"))
    new = inside.join(over, "head").select("topic", "ancestor", (F.col("below") + F.col("above")).alias("distance"))
    return closure.join(old, ["topic", "ancestor"], "left_anti").unionByName(new)


#: Parts into which the rows of one key are dealt before its best are put together.
PARTS = 512


def within_budget(rows: DataFrame, key: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The first rows of each key in order whose costs before them, which aren't negative, sum up to ``budget`` at most,
    with that sum as ``before`` and ``position`` from 1. A key's rows are dealt over PARTS: what a part alone rules out is
    out, as costs of other parts only add to the sum, and the first row over the budget stays, so that those after it are
    ruled out by the sum over all parts too. So no task sorts more than a part, or PARTS times what fits the budget."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*rows.columns[:3]), F.lit(PARTS)))
    for keys in ([key, "__part"], [key]):
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("before", F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = (rows.withColumn("position", F.row_number().over(w)) if keys == [key] else rows).where(F.col("before") <= budget)
    return rows.drop("__part")


def states(topics: DataFrame, state: DataFrame) -> DataFrame:
    return topics.join(state, topics["id"] == state["topic_id"], "left").drop("topic_id")


def briefs(topics: DataFrame, state: DataFrame, papers: DataFrame, links: DataFrame, gaps: DataFrame, most: int | None = None) -> DataFrame:
    """One row per topic: topic, state (or null), its papers by relevance, its gaps by priority, all of them or the first
    ``most``, which bounds a row however many papers a topic has. Three aggregations, each keyed by topic, then joined to
    the topics."""

    def listed(rows: DataFrame, score: str, key: str, label: str, name: str) -> DataFrame:
        if most is not None:
            rows = within_budget(rows, "topic_id", [F.desc(score), F.asc(key)], F.lit(1), most - 1).drop("before", "position")
        rows = rows.groupBy("topic_id").agg(F.collect_list(F.struct((-F.col(score)).alias("r"), F.col(key).alias("id"), label)).alias("l"))
        return rows.select("topic_id", F.transform(F.array_sort("l"), lambda s: F.struct(s["id"].alias("id"), s[label].alias(label))).alias(name))

    p = listed(links.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id").select("topic_id", "paper_id", "relevance", "title"), "relevance", "paper_id", "title", "papers")
    g = listed(gaps.select("topic_id", "id", "priority", "description"), "priority", "id", "description", "gaps")
    s = state.select("topic_id", F.struct(*[c for c in state.columns if c != "topic_id"]).alias("state"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = topics.withColumnRenamed("id", "topic_id").join(s, "topic_id", "left").join(p, "topic_id", "left").join(g, "topic_id", "left")
    return out.withColumns({"papers": none("papers", "array<struct<id:string,title:string>>"), "gaps": none("gaps", "array<struct<id:string,description:string>>")})


def report_material(ids: list[str], brief_rows: DataFrame) -> DataFrame:
    """Briefs of the topics in the order given; an unknown topic is an error."""
    wanted = brief_rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, topic_id string")
    missing = wanted.join(brief_rows.select("topic_id"), "topic_id", "left_anti").limit(1).collect()
    if missing:
        raise Validation(f"no such topic: {missing[0]['topic_id']}")
    return wanted.join(brief_rows, "topic_id").orderBy("position")


def report_context(papers: DataFrame, links: DataFrame, budget: int = REPORT_TOKENS) -> DataFrame:
    """Per topic the lines of the most relevant papers that fit the budget. The first is always there; costs aren't
    negative, so a running sum is the loop that stops at the first misfit."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), "abstract_text", F.lit("\n"))
    rows = links.join(papers.select(F.col("id").alias("paper_id"), "created_at", line.alias("line"), T.tokens(line).alias("cost")), "paper_id")
    rows = within_budget(rows.select("topic_id", "paper_id", "relevance", "created_at", "line", "cost"), "topic_id", paper_order(), F.col("cost"), budget)
    return rows.where((F.col("before") + F.col("cost") <= budget) | (F.col("position") == 1)).select("topic_id", "paper_id", "position", "line", "cost")


def keyword_batch(papers: DataFrame, budget: int = KEYWORD_TOKENS, most: int = 1000) -> DataFrame:
    """The first papers without keywords whose blocks fit the budget. Rows are limited before the running sum, as no
    more than the budget's number of one-token blocks can fit."""
    block = F.concat("id", F.lit("|"), "title", F.lit("\n"), F.substring("abstract_text", 1, 600), F.lit("\n\n"))
    rows = papers.where(F.col("keywords") == "").orderBy(F.desc("created_at"), "id").limit(min(most, budget))
    w = Window.orderBy(F.desc("created_at"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("id", "created_at", block.alias("block"), T.tokens(block).alias("cost")).withColumn("used", F.sum("cost").over(w))
    return rows.where(F.col("used") <= budget).select("id", "block", "cost", "used")


def gap_context(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Per topic all papers' blocks in order, cut if they are too long. Blocks after the cut aren't gathered."""
    block = F.concat(F.lit("Title: "), "title", F.lit("\nAbstract: "), "abstract_text", F.lit("\n"))
    rows = links.join(papers.select(F.col("id").alias("paper_id"), "created_at", block.alias("block")), "paper_id")
    rows = within_budget(rows.select("topic_id", "paper_id", "relevance", "created_at", "block"), "topic_id", paper_order(), F.length("block") + 5, GAP_CHARS + 5)
    near = rows.groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "block"))), lambda s: s["block"]), "\n---\n").alias("t"))
    return near.select("topic_id", F.when(T.tokens(F.col("t")) > GAP_TOKENS, F.substring("t", 1, GAP_CHARS)).otherwise(F.col("t")).alias("context"))


def record_gaps(rows: DataFrame) -> DataFrame:
    """Gaps to store: blank descriptions go, types and priorities are made valid."""
    return rows.where(T.strip(F.col("description")) != "").withColumns({"description": T.strip(F.col("description")), "gap_type": T.gap_type(F.col("gap_type")), "priority": T.priority(F.col("priority"))})


def refresh_gap_counts(state: DataFrame, gaps: DataFrame) -> DataFrame:
    """State with gaps_identified counted anew; topics without a state get one, all else stays."""
    counts = gaps.groupBy("topic_id").agg(F.count("*").alias("n"))
    rest = [c for c in state.columns if c not in ("topic_id", "gaps_identified")]
    return state.join(counts, "topic_id", "full").select("topic_id", F.coalesce("n", F.lit(0).cast("long")).alias("gaps_identified"), *[F.coalesce(c, F.lit(0)).alias(c) for c in rest])


def accepted(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies (id, keywords) with whether the id was asked for."""
    return replies.join(candidates.select("id").distinct().withColumn("__in", F.lit(True)), "id", "left").select("id", "keywords", F.coalesce("__in", F.lit(False)).alias("accepted"))
