"""A stored index of kept documents' segment sets, which batches probe and add to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup


#: Tasks that write one bucket of a batch at most.
SHARES = 16


@dataclass
class NearIndex:
    """Documents kept so far, below path: rows as they came, their segment sets, and the sets' prefixes as postings.

    Sets are ordered by how many sets of the first batch have a segment, rarest first; that order is stored and never
    changes, as prefixes that are compared must follow one order. Postings and sets lie in `buckets` folders by hash:
    a batch reads those that it touches. What a batch writes is in folders of its own, so a batch that is
    run again, under the same number, replaces what it wrote and doesn't see it.
    """

    path: str
    limit: float = 0.5
    key: str = "doc_id"
    text: str = "text"
    buckets: int = 64

    def stored(self, spark: SparkSession, what: str, batch: int, touched: DataFrame | None = None) -> DataFrame | None:
        """What other batches have stored, of the buckets touched (at most `buckets` numbers); None if nothing."""
        try:
            rows = spark.read.option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")
        except AnalysisException:
            return None
        rows = rows.filter(F.col("batch") != batch)
        return rows if touched is None else rows.filter(F.col("bucket").isin([r["bucket"] for r in touched.select("bucket").distinct().collect()]))

    def bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias("bucket")

    def order(self, sets: DataFrame) -> DataFrame:
        """(s, f): the segments that more than one set of the first batch has."""
        spark, path = sets.sparkSession, f"{self.path}/order"
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

    def prefixes(self, sets: DataFrame) -> DataFrame:
        """(key, n, at, s, bucket): each set's prefix."""
        each = sets.select(self.key, F.size("set").alias("n"), F.explode("set").alias("s")).join(self.order(sets), "s", "left")
        ordered = each.groupBy(self.key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s"))).alias("o"))
        return ordered.select(self.key, "n", F.posexplode(F.slice("o", F.lit(1), dedup.prefix_length(F.col("n"), self.limit))).alias("at", "e")).select(self.key, "n", "at", "e.s", self.bucket("e.s"))

    def like_stored(self, sets: DataFrame, ahead: DataFrame, batch: int) -> DataFrame:
        """Keys of the batch's sets that are like a stored one."""
        none = sets.select(self.key).limit(0)
        postings = self.stored(sets.sparkSession, "postings", batch, ahead)
        if postings is None:
            return none
        old = postings.select(F.col(self.key).alias("_old"), F.col("n").alias("_n"), F.col("at").alias("_at"), "s")
        met = ahead.join(old, "s").filter(dedup.may_reach(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"), self.limit))
        met = met.select(self.key, "_old").distinct().withColumn("bucket", self.bucket("_old")).checkpoint()
        kept = self.stored(sets.sparkSession, "sets", batch, met)
        if kept is None:
            return none
        both = met.join(kept.select(F.col(self.key).alias("_old"), F.col("set").alias("_set")), "_old").join(sets, self.key)
        return both.filter(dedup.similarity(F.col("set"), F.col("_set")) >= self.limit).select(self.key).distinct()

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Store those of the batch's rows that are like none stored and none that stays before them in the batch; returns them.

        Keys are to be unique and to rise from batch to batch: then all batches together keep what dedup.greedy_kept keeps of all rows.
        """
        sets = dedup.first_of(dedup.segment_nodes(rows, self.key, self.text).checkpoint(), self.key).checkpoint()
        ahead = self.prefixes(sets).checkpoint()
        fresh = sets.join(self.like_stored(sets, ahead, batch), self.key, "left_anti").checkpoint()
        kept = fresh.join(dedup.greedily_dropped(dedup.set_pairs(fresh, self.limit, self.key), self.key), self.key, "left_anti").checkpoint()
        keys = kept.select(self.key)
        for what, table in (("postings", ahead.join(keys, self.key, "left_semi")), ("sets", kept.select(self.key, "set", self.bucket(self.key)))):
            # a bucket is written by several tasks, else no more tasks write than there are buckets
            table.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(SHARES))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{what}/batch={batch}")
        rows.join(keys, self.key, "left_semi").dropDuplicates([self.key]).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        return rows.sparkSession.read.parquet(f"{self.path}/rows/batch={batch}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows kept so far."""
        return spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").drop("batch")
