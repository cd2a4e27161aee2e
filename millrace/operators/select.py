"""Selectors, groupers and seeded samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import first_by_hash, numbered


def top_k(df: DataFrame, field: str, k: int, key: str, ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) values; ties by key."""
    return df.orderBy(F.asc(field) if ascending else F.desc(field), key).limit(k)


def by_frequency(df: DataFrame, field: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent; ties by value."""
    counts = df.groupBy(field).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), field).limit(k)
    return df.join(counts, field, "left_semi")


def by_range(df: DataFrame, field: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two quantiles of the field, both included; a quantile is the first value that such a share of the rows does not exceed."""
    values = df.select(field).filter(F.col(field).isNotNull())
    n = values.count()
    at = [max(1, math.ceil(q * n - 1e-9)) for q in (low, high)]
    found = {r["place"]: r[field] for r in numbered(values, [], [field]).filter(F.col("place").isin(*at)).collect()}  # two rows
    return df.filter(F.col(field).between(found.get(at[0]), found.get(at[1])))


def by_hash(df: DataFrame, key: str, k: int, seed: str = "7") -> DataFrame:
    """A reproducible sample of k rows: the smallest md5 of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(k)


def tagged(df: DataFrame, field: str, values: tuple) -> DataFrame:
    return df.filter(F.col(field).isin(*values))


def grouped(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row a key with its rows as an ordered array."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias("batch"))


def ungrouped(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode("batch").alias("_")).select(*keys, "_.*")


def per_source(df: DataFrame, source: str, counts: dict[str, int], key: str, seed: str = "7", eligible: Column | None = None) -> DataFrame:
    """At most counts[source] rows of each source, the first in order of a seeded md5; a row that an earlier source took is not replaced."""
    wanted = F.create_map(*(x for s, n in counts.items() for x in (F.lit(s), F.lit(n))))
    rows = df.filter(F.col(source).isin(*counts)) if eligible is None else df.filter(F.col(source).isin(*counts) & eligible)
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    return first_by_hash(rows, source, order, max(counts.values()), F.col(key), "_turn").filter(F.col("_turn") <= F.element_at(wanted, F.col(source))).drop("_turn")
