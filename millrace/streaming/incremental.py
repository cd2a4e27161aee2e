"""Collection as it arrives: files, exact duplicates and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .near_index import NearIndex


def collect(spark: SparkSession, path: str, schema: str, to: str, state: str, form: str = "parquet") -> StreamingQuery:
    """Move what is new in a folder to a table and stop: run again, it goes on where it ended."""
    rows = spark.readStream.schema(schema).format(form).load(path)
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", state).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, time: str, delay: str, text: str = "text") -> DataFrame:
    """Rows whose text was not seen within the delay; the state holds digests of that span only."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).withColumn("digest", F.md5(text)).dropDuplicatesWithinWatermark(["digest"])


def counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Rows and sums of value by window and keys; late rows count up to the delay."""
    grouped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def near_new(stream: DataFrame, known: str, state: str, limit: float = 0.5, key: str = "doc_id") -> StreamingQuery:
    """Add to the index at known (near_index.NearIndex) what is not like a document that it holds, batch by batch; keys must rise with arrival.

    A batch probes the index and adds to it; documents known are not compared again. One state folder goes with one index.
    """
    index = NearIndex(known, limit, key)
    return stream.writeStream.foreachBatch(lambda batch, n: index.add(batch, n) and None).option("checkpointLocation", state).trigger(availableNow=True).start()
