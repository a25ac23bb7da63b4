"""A research library derived from the driver's tables, by integer arithmetic only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GAP_TYPE, PAGE_MARK, PAPER_STATUS, READING_STATUS


class Fixture:
    """Views over one folder of tables; each is read lazily and pruned to what a query needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def papers(self, rated: bool = False) -> DataFrame:
        d = self.table("documents")
        n, k = F.col("doc_id"), F.expr("doc_id div 12").cast("string")
        doi = F.when(n % 6 == 0, F.concat(F.lit("https://doi.org/10.1/X"), k)).when(n % 6 == 1, F.concat(F.lit("doi:10.1/x"), k)).when(n % 6 == 2, F.concat(F.lit("10.1/X"), k)).when(n % 6 == 3, F.concat(F.lit(" http://dx.doi.org/10.1/x"), k, F.lit(" ")))
        pick = lambda i, values: reduce(lambda c, x: c.when(i == x[0], x[1]), enumerate(values), F)
        rating = F.lit(None).cast("int")
        if rated:
            good = self.table("labels").where("quality = 1").select("doc_id", F.lit(1).alias("good")).distinct()
            d = d.join(good, "doc_id", "left")
            rating = F.when(F.col("good") == 1, (1 + n % 5).cast("int"))
        return d.select(
            F.concat(F.lit("p"), n.cast("string")).alias("id"), n.alias("seq"),
            F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.substring("text", 1, 1000).alias("abstract_text"),
            (2000 + n % 26).cast("int").alias("year"), F.col("source").alias("venue"), doi.alias("doi"),
            F.when(n % 5 == 0, F.concat(F.lit("2301."), F.lpad(n.cast("string"), 5, "0"), F.lit("v1"))).alias("arxiv_id"),
            F.when(n % 7 == 0, F.concat(F.lit("s"), n.cast("string"))).alias("s2_id"),
            F.when(n % 11 == 0, F.concat(F.lit("/pdf/"), n.cast("string"), F.lit(".pdf"))).alias("pdf_path"),
            F.when(n % 13 == 0, F.concat(F.lit("https://example.org/"), n.cast("string"))).alias("url"),
            F.when(n % 4 == 0, F.concat(F.lit("https://openalex.org/W"), n.cast("string"))).alias("openalex_id"),
            pick(n % 5, PAPER_STATUS).alias("status"), pick(F.expr("doc_id div 5") % 5, READING_STATUS).alias("reading_status"), F.lit("").alias("notes"),
            F.array("lang", "source").alias("tags"), F.lit(0.5).alias("relevance_score"), rating.alias("rating"),
            F.when(n % 3 == 0, "").otherwise(F.concat_ws("; ", "lang", "source")).alias("keywords"), _stamp(n).alias("created_at"), _stamp(n * 7919 % 1000).alias("updated_at"),
        )

    def topics(self) -> DataFrame:
        nulls = F.lit(None).cast("string")
        region = self.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), nulls.alias("parent_topic_id"), F.lit(0).alias("depth"), ((F.col("r_regionkey") % 10) / 10).alias("priority"))
        nation = self.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_topic_id"), F.lit(1).alias("depth"), ((F.col("n_nationkey") % 10) / 10).alias("priority"))
        return region.unionByName(nation)

    def topic_papers(self) -> DataFrame:
        n = F.col("doc_id")
        return self.table("documents").select(F.concat(F.lit("n"), n % 25).alias("topic_id"), F.concat(F.lit("p"), n).alias("paper_id"), ((n * 37 % 100) / 100).alias("relevance"))

    def bodies(self) -> DataFrame:
        """Short bodies with page marks and sections."""
        turn = F.struct("turn", F.concat(F.lit(PAGE_MARK), F.col("turn") + 1, F.lit(" -->\n## "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("t"))
        return self.table("conversations").groupBy(F.concat(F.lit("p"), F.col("conv_id")).alias("paper_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda s: s["t"]), "").alias("body"))

    def long_bodies(self) -> DataFrame:
        return self.table("documents").select(F.concat(F.lit("p"), F.col("doc_id")).alias("paper_id"), F.col("text").alias("body"))

    def citations(self) -> DataFrame:
        label = F.when(F.col("flag") == "A", "background").when(F.col("flag") == "R", "methodology").otherwise("")
        pairs = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("seq"), F.min("l_returnflag").alias("flag"))
        return pairs.select(F.concat(F.lit("p"), F.col("l_orderkey")).alias("citing"), F.concat(F.lit("p"), F.col("l_partkey")).alias("cited"), label.alias("context"), F.col("seq").cast("long").alias("seq"), F.col("l_orderkey").alias("order_key"))

    def gaps(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey")
        names = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), GAP_TYPE, strict=True))
        kind = reduce(lambda k, x: k.when(F.col("o_orderpriority") == x[0], x[1]), names.items(), F).otherwise(GAP_TYPE[0])
        rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            F.concat(F.lit("g"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("gap "), F.col("o_orderkey"), F.lit(" "), F.col("o_orderpriority")).alias("description"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("topic_id"),
            kind.alias("gap_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("o_totalprice") / 400000)).alias("priority"), F.col("o_orderdate").cast("date").cast("string").alias("discovered_at"),
        )

    def state(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").where(n % 2 == 0).select(F.concat(F.lit("n"), n).alias("topic_id"), (n % 7).alias("papers_read"), (n % 5).alias("papers_queued"), F.lit(0).alias("gaps_identified"), (n % 10 / 10).alias("coverage_score"))

    def reports(self) -> DataFrame:
        n = F.col("r_regionkey").cast("string")
        text = F.concat(F.lit("# "), F.col("r_name"), F.lit("\nlead\n## Scope \nAll of "), F.col("r_name"), F.lit("\nand more\n\n## Open questions\n\nNumber "), n, F.lit("\n"))
        return self.table("region").select(F.concat(F.lit("rep"), n).alias("id"), F.col("r_name").alias("title"), F.when(F.col("r_regionkey") == 0, F.concat(F.lit("# T\n\nplain "), n)).otherwise(text).alias("content"), F.concat(F.lit("2024-01-0"), n).alias("generated_at"))

    def incoming(self) -> DataFrame:
        n, k = F.col("doc_id"), F.expr("doc_id div 12").cast("string")
        own = self.table("documents").select(F.concat(F.lit("i"), n).alias("id"), F.concat(F.replace(F.substring(F.substring_index("text", "\n", 1), 1, 80), F.lit(" "), F.lit(" - ")), F.lit(" !")).alias("title"), F.when(n % 6 < 4, F.concat(F.lit("https://dx.doi.org/10.1/X"), k)).alias("doi"), F.when(n % 11 == 0, F.concat(F.lit("/pdf/"), n, F.lit(".pdf"))).alias("pdf_path"), n.alias("seq"))
        new = self.table("benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), F.substring("text", 1, 80).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("pdf_path"), (F.col("item_id") + 1_000_000_000).alias("seq"))
        return own.unionByName(new)

    def remote_items(self) -> DataFrame:
        """Items of a remote library: none for some identifiers, two for others, tags with padding and blanks."""
        keys = self.table("documents").select(F.expr("doc_id div 12").alias("k")).distinct().where("k % 4 != 0")
        rows = keys.withColumn("copy", F.explode(F.when(F.col("k") % 9 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        tags = F.when(F.col("k") % 5 == 0, F.array(*map(F.lit, (" en ", "", *(f"src{i}" for i in range(20)), "de", "fr", "es")))).otherwise(F.array(F.lit(" en "), F.lit(" "), F.lit("kept")))
        return rows.select(F.concat(F.lit("z"), F.col("k"), F.lit("-"), F.col("copy")).alias("key"), F.concat(F.lit("DOI:10.1/X"), F.col("k")).alias("raw"), F.concat(F.lit("10.1/X"), F.col("k")).alias("doi"), (F.col("k") + F.col("copy")).alias("version"), tags.alias("tags")).drop("raw")


def _stamp(n: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    part = lambda d: F.floor(n / d)
    return F.concat(F.lit("20"), two(part(29_030_400) % 80 + 20), F.lit("-"), two(n % 12 + 1), F.lit("-"), two(part(12) % 28 + 1), F.lit("T"), two(part(336) % 24), F.lit(":"), two(part(8064) % 60), F.lit(":"), two(part(483_840) % 60), F.lit("Z"))
