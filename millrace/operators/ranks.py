"""Places in an order, however many rows a group has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "place") -> DataFrame:
    """df with each row's place, from 1, among the rows of its keys (of all rows, without keys) in that order.

    Rows are sorted over all tasks by keys and order; each task numbers what it holds, and what earlier tasks hold of
    a key is added, a row a key and task. Null keys are a group. Rows that tie are numbered in any order.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, *keys, *order).withColumn("_task", F.spark_partition_id()).checkpoint()
    local = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_task").orderBy(*order)))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_task").alias("_of_task"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.col("_task") == F.col("_of_task"))
    return local.join(before, same).select(*df.columns, (F.col("_before") + F.col("_at")).alias(out))


def first_by_hash(df: DataFrame, group: str, order: list[Column], most: int, spread: Column, out: str) -> DataFrame:
    """The first `most` rows of each group in that order, numbered; first of each part of a group, parts by the hash of spread, so that no task sorts a whole group."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(tasks))).withColumn(out, place(group, "_part")).filter(F.col(out) <= most)
    return some.withColumn(out, place(group)).filter(F.col(out) <= most).drop("_part")
