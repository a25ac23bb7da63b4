"""Fill-in-middle transformation with relational units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

#: A unit is a word of letters or one other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units are exploded in runs of so many first, and then only in the runs that a cut lies in.
RUN = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_RATE, SPM_RATE = 90, 20


def draws(seed: str, key: Column) -> list[Column]:
    """Four whole numbers of 32 bits from the hash of a row's key; they need no state and are the same in every run."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1:", fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output. Texts are cut between units at two drawn ordinals and put
    together as prefix, suffix, middle (psm) or suffix, prefix, middle (spm), or left plain: empty texts, those that hold
    a mark already, and a drawn rest.

    Runs of units are exploded with their ordinals, a window sums up the lengths before each, and the cut requests are
    joined to the run that holds their ordinal; the units of that run are exploded and summed likewise, and the offsets are
    gathered into one row per document, which is cut by them. All of this is keyed by a number of the row, so rows that
    share a doc_id, or have none, are kept apart and spread evenly; texts are shuffled once, and no task holds more than its
    own rows. Null text counts as empty, a null id as an empty one for the draws; repeated rows give equal rows each; an
    empty table gives no rows; other columns, whatever their names, are not read."""
    h = draws(seed, F.col("doc_id"))
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long")).repartition("row")
    mine = ("row", "doc_id", "n")  # all columns of the exchange, so that its three readers share one
    marked = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when(marked | (h[2] % 100 >= fim_rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    runs = rows.select(*mine, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?:[A-Za-z]++|[^A-Za-z]){{1,{RUN}}}+"), F.lit(0))).alias("at", "run"))
    by_row = Window.partitionBy(*mine).orderBy("at")
    runs = runs.withColumn("before", F.coalesce(F.sum(F.length("run")).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    first = F.col("at").cast("long") * RUN
    cuts = F.transform(F.array(*h[:2]), lambda x: x % (F.col("n") + 1))
    requests = rows.select(F.col("row").alias("asked"), F.posexplode(F.when(form != "plain", F.array_sort(cuts))).alias("which", "ordinal")).where("ordinal > 0")
    found = runs.join(requests, (F.col("row") == F.col("asked")) & (F.col("ordinal") > first) & (F.col("ordinal") <= first + RUN))
    units = found.select("row", "which", "before", (F.col("ordinal") - first).alias("ordinal"), F.posexplode(F.regexp_extract_all("run", F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    units = units.withColumn("end", F.col("before") + F.sum(F.length("unit")).over(Window.partitionBy("row", "which").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    offsets = units.where(F.col("ordinal") == F.col("at") + 1).groupBy("row").agg(*[F.max(F.when(F.col("which") == i, F.col("end"))).alias(name) for i, name in enumerate(("p", "m"))])
    out = rows.join(offsets, "row", "left").select("doc_id", "text", "n", form.alias("form"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("p", "m")])
    prefix, middle, suffix = F.substring("text", F.lit(1), F.col("p")), F.substring("text", F.col("p") + 1, F.col("m") - F.col("p")), F.substring("text", F.col("m") + 1, F.length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return out.select(
        "doc_id", "n", "form", F.when(cut, F.col("p")).alias("prefix_chars"), F.when(cut, F.col("m") - F.col("p")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS h FROM t),
c AS (SELECT doc_id, text, units, len(units) AS n, h, h[1] % (len(units) + 1) AS a, h[2] % (len(units) + 1) AS b FROM u),
f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""
