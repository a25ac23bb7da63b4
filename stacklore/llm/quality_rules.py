"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

DataFrame operations only. All sums are of fixed-point integers, so estimates don't depend on how rows are dealt out.

Estimates are made for every language and source, every language, and all rows, from the same passes. Each has several
starts: medians and quartiles, and small subsets chosen by hash. Concentration steps take the mean and covariance of
exactly the h nearest rows, which never raises the determinant; after FIRST_STEPS the start of the least determinant
goes on. A small group is then drawn to its language, and that to all rows, by one rule for all sizes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, keyed_join, read_table, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Fixed-point units of a feature; standard deviations that are added to the covariances, as clean texts can agree in a
#: feature altogether.
UNIT = 1024
FLOORS = (0.30, 0.06, 0.04, 0.12, 0.12)
P = len(FLOORS)
#: Starts by subsets of P + 1 rows beside the one by medians; steps of all starts, and of the one that goes on.
SUBSETS, FIRST_STEPS, STEPS = 5, 2, 2
#: Rows by whose weight an estimate is drawn to the next larger group's.
DRAWN = 50
#: Chi-square of P degrees: median, 0.975 quantile for reweighting, share of the covariance that rows inside it show.
CHI_MEDIAN, CHI_REWEIGHT, INSIDE = 4.351, 12.833, 0.9474
#: Share of clean rows that may be rejected, were they normal.
TAIL = 1e-9
BINS_PER_OCTAVE, SLICES = 64, 4096


def chi_tail(x: float) -> float:
    """Share of a chi-square distribution of P = 5 degrees beyond x."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def chi_quantile(tail: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        low, high = ((low + high) / 2, high) if chi_tail((low + high) / 2) > tail else (low, (low + high) / 2)
    return high


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    rows = docs.select("doc_id", *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")), text_or_empty().alias("t"))
    trimmed = F.trim("t", F.lit(" \t\n\x0b\x0c\r"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias("w"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        "doc_id", "lang", "source", "w", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(repeated, placed))

    def same(a: Column, b: Column) -> Column:
        p, q = F.get("s", a), F.get("s", b)
        words = [F.get("w", p["i"] + k) == F.get("w", q["i"] + k) for k in range(3)]
        return F.coalesce(reduce(Column.__and__, [p["x"] == q["x"], *words]), F.lit(False))

    hits = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get("s", j)["i"])), lambda x: x.isNotNull())
    rows = rows.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(hits)))
    covered = F.aggregate(F.transform("at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def with_features(rows: DataFrame) -> DataFrame:
    """Adds x0 .. x4: transformed statistics in fixed-point units."""
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    made = (F.log1p("n_words"), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words))
    return rows.withColumns({f"x{i}": F.round(x * UNIT).cast("long") for i, x in enumerate(made)})


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SUMS = [*(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]
XS = [f"x{i}" for i in range(P)]


def with_groups(rows: DataFrame) -> DataFrame:
    """Adds g0, g1, g2: names of all rows, of the language, and of the language and source."""
    null = F.lit("\x02")
    lang, source = F.coalesce("lang", null), F.coalesce("source", null)
    return rows.withColumns({"g0": F.lit(""), "g1": F.concat(F.lit("1\x01"), lang), "g2": F.concat_ws("\x01", F.lit("2"), lang, source)})


def from_sums(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, n, means m, the lower Cholesky factor l of the covariance with FLOORS added, log of its determinant."""
    out = sums.withColumn("n", F.col("n").cast("double")).withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / UNIT for i in range(P)})
    cov = lambda i, j: F.col(f"q{i}{j}") / F.col("n") / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}")
    return factored(out.withColumns({f"c{i}{j}": cov(i, j) for i, j in PAIRS}), *keys, "n")


def factored(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, m, l and det from means m and covariances c."""
    out = rows
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(Column.__add__, [2 * F.log(f"l{i}{i}") for i in range(P)])
    return out.select(*keep, *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS], *[f"l{i}{j}" for i, j in PAIRS], det.alias("det"))


def with_distance(rows: DataFrame, estimates: DataFrame, n: int, *keep: str) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to each of the ``n`` estimates of the row's group g, by forward
    substitution, and the columns ``keep`` of the estimate."""
    factors = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS)]
    rows = keyed_join(rows, estimates.select("g", *keep, *factors), ["g"], rows=n)
    for i in range(P):
        rest = F.col(f"x{i}") / UNIT - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = reduce(Column.__add__, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)])
    return rows.withColumn("d2", d2).drop(*(f"y{i}" for i in range(P)), *factors)


def _sums() -> list[Column]:
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *products]


def _by_medians(points: DataFrame) -> DataFrame:
    """Per group: medians and interquartile scales from exact counts, as a diagonal estimate."""
    step = UNIT // 64
    long = points.select("g", F.posexplode(F.array(*[F.floor(F.col(x) / step) for x in XS])).alias("i", "b")).groupBy("g", "i", "b").count()
    w = Window.partitionBy("g", "i")
    share = F.sum("count").over(w.orderBy("b")) / F.sum("count").over(w)
    at = lambda q: (F.min(F.when(F.col("share") >= q, F.col("b"))) * step + step / 2) / UNIT
    one = long.withColumn("share", share).groupBy("g", "i").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = one.groupBy("g").agg(*[pick(i, "m").alias(f"m{i}") for i in range(P)], *[F.pow(pick(i, "s"), 2).alias(f"c{i}{i}") for i in range(P)])
    wide = wide.withColumns({f"c{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j} | {"start": F.lit(0), "n": F.lit(0.0)})
    return factored(wide, "g", "start", "n")


def _by_subsets(points: DataFrame, subsets: int) -> DataFrame:
    """Per group and subset the estimate of up to P + 1 rows, the least by hash of as many parts."""
    dealt = points.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(subsets)))).withColumn("h", F.xxhash64("start", *XS))
    least = dealt.groupBy("g", "start", F.pmod("h", F.lit(P + 1)).alias("part")).agg(F.min(F.struct("h", *XS)).alias("r"))
    return from_sums(least.select("g", "start", *[f"r.{x}" for x in XS]).groupBy("g", "start").agg(*_sums()), "g", "start")


def concentrated(points: DataFrame, estimates: DataFrame, n: int, scratch: Scratch, name: str, fine: bool = True) -> DataFrame:
    """One step of ``n`` estimates: those of exactly the h rows nearest to each estimate, h = (n + P + 1) / 2 as usual.

    Rows are summed in bins of distance. Rows of the bin that holds the h-th one share what is left of h; if ``fine``,
    that bin is first cut into SLICES, whose distances agree to some millionths. So a group of any size comes down to a
    few thousand sums before it is shuffled, and no group is sorted."""
    place = F.log2(F.col("d2") + 2.0**-10) * BINS_PER_OCTAVE
    w = Window.partitionBy("g", "start")
    before = F.sum("n").over(w.orderBy("b")) - F.col("n")
    bins = with_distance(points, estimates, n, "start").groupBy("g", "start", F.floor(place).alias("b")).agg(*_sums())
    bins = bins.withColumns({"below": before, "all": F.sum("n").over(w)})
    bins = bins.withColumn("left", F.least("all", F.floor((F.col("all") + P + 1) / 2)) - F.col("below"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("left") / F.col("n")))
    used = bins.where("left > 0").select("g", "start", "b", "left", weight.alias("w"), "n", *SUMS)
    if fine:
        used = scratch.save(used, f"{name}-bins")
        edge = used.where("left <= n").select("g", "start", F.col("b").alias("edge"), "left")
        cut = with_distance(points, keyed_join(estimates, edge, ["g", "start"], rows=n), n, "start", "edge", "left").where(F.floor(place) == F.col("edge"))
        cut = cut.groupBy("g", "start", "left", F.floor((place - F.col("edge")) * SLICES).alias("b")).agg(*_sums()).withColumn("left", F.col("left") - before)
        used = used.where("left > n").drop("b", "left").unionByName(cut.where("left > 0").select("g", "start", weight.alias("w"), "n", *SUMS))
    whole = lambda c: F.sum(F.when(F.col("w") == 1, F.col(c)).otherwise(0))  # noqa: E731 -- whole numbers, in any order
    part = lambda c: F.sum(F.when(F.col("w") < 1, F.col("w") * F.col(c)).otherwise(0.0))  # noqa: E731 -- one slice at most
    total = used.groupBy("g", "start").agg(*[(whole(c) + part(c)).alias(c) for c in ("n", *SUMS)])
    return scratch.save(from_sums(total, "g", "start"), name)


def least_determinants(points: DataFrame, scratch: Scratch, subsets: int = SUBSETS, first: int = FIRST_STEPS, steps: int = STEPS) -> DataFrame:
    """For each group g the estimate of the least determinant over all starts."""
    estimates = scratch.save(_by_medians(points).unionByName(_by_subsets(points, subsets)), "starts")
    n = estimates.count()
    for k in range(first):
        estimates = concentrated(points, estimates, n, scratch, f"first{k}", False)
    best = estimates.groupBy("g").agg(F.min(F.struct("det", "start")).alias("best")).select("g", F.col("best.start").alias("start"))
    estimates = scratch.save(estimates.join(best, ["g", "start"]), "best")
    n = estimates.count()
    for k in range(steps):
        estimates = concentrated(points, estimates, n, scratch, f"step{k}")
    return estimates


def reweighted(points: DataFrame, estimates: DataFrame, scratch: Scratch) -> DataFrame:
    """Estimates from all rows inside the 0.975 ellipse of each group's, whose median distance sets the scale."""
    place = F.floor(F.log2(F.col("d2") + 2.0**-10) * BINS_PER_OCTAVE)
    n = estimates.count()
    counts = with_distance(points, estimates, n).groupBy("g", place.alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    counts = counts.withColumn("share", F.sum("n").over(w.orderBy("b")) / F.sum("n").over(w))
    middle = F.min(F.when(F.col("share") >= 0.5, F.pow(F.lit(2.0), (F.col("b") + 1) / BINS_PER_OCTAVE)))
    limits = counts.groupBy("g").agg(F.greatest(middle * CHI_REWEIGHT / CHI_MEDIAN, F.lit(1.0)).alias("limit"))
    limits = scratch.save(estimates.join(limits, "g"), "limits")
    near = with_distance(points, limits, n, "limit").where("d2 <= limit").groupBy("g").agg(*_sums())
    return scratch.save(from_sums(near, "g").withColumns({f"c{i}{j}": F.col(f"c{i}{j}") / INSIDE for i, j in PAIRS}), "reweighted")


def drawn(rows: DataFrame, estimates: DataFrame, weight: float = DRAWN) -> DataFrame:
    """For each language and source g its estimate, drawn to the language's, which is drawn to that of all rows: the mean
    of both by their rows, of which the larger group counts as ``weight``."""
    moments = [*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]
    table = estimates.select("g", "n", *moments)
    out = rows.select("g0", "g1", "g2").distinct().join(table.withColumnRenamed("g", "g0").drop("n"), "g0")
    for key in ("g1", "g2"):
        own = table.select(F.col("g").alias(key), "n", *[F.col(c).alias(f"own_{c}") for c in moments])
        out = out.join(own, key).withColumns({c: (F.col("n") * F.col(f"own_{c}") + weight * F.col(c)) / (F.col("n") + weight) for c in moments}).drop("n", *(f"own_{c}" for c in moments))
    return factored(out.withColumnRenamed("g2", "g"), "g")


def quality_rules(docs: DataFrame, cutoff: float | None = None) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept for each row.

    A row is rejected by the base rule, or if its squared distance exceeds ``cutoff``, by default the chi-square quantile
    of TAIL. Null texts have no words; null languages and sources form groups of their own; a group of any size, one row
    too, is judged by the same rule; an empty table gives no rows. Repeated rows and ties count as often as they
    occur."""
    scratch = Scratch(docs.sparkSession)
    cutoff = chi_quantile(TAIL) if cutoff is None else cutoff
    rows = scratch.save(with_groups(with_features(base_statistics(docs))), "statistics")
    points = rows.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *XS)
    estimates = reweighted(points, least_determinants(points, scratch), scratch)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    groups = scratch.save(drawn(rows, estimates), "drawn")
    scratch.keep("statistics", "drawn")
    judged = with_distance(rows.withColumnRenamed("g2", "g"), groups, groups.count()).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("d2") <= cutoff)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
