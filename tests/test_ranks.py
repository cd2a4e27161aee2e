"""Places in an order, against sorted lists."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators import ranks, select


def test_numbered(spark):
    """A key with a third of all rows, null keys, and nulls in the order."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, *range(40)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(5)
    want, groups = {}, defaultdict(list)
    for i, g, v in rows:
        groups[g].append((v is not None, v or 0, i))
    for members in groups.values():
        want |= {i: n + 1 for n, (*_, i) in enumerate(sorted(members))}
    assert {r.id: r.place for r in ranks.numbered(df, ["g"], ["v", "id"]).collect()} == want
    whole = sorted((v is not None, v or 0, i) for i, _, v in rows)
    assert {r.id: r.place for r in ranks.numbered(df, [], ["v", "id"]).collect()} == {i: n + 1 for n, (*_, i) in enumerate(whole)}
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).collect() == []


def test_first_by_hash(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("m"))
    got = {(r.g, r.turn): r.id for r in ranks.first_by_hash(df, "g", [F.col("m")], 7, F.col("id"), "turn").collect()}
    rows = sorted((r.g, r.m, r.id) for r in df.collect())
    assert got == {(g, n + 1): [i for h, _, i in rows if h == g][n] for g in range(3) for n in range(7)}


def test_range_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(None,), *[(v,) for v in (1, 1, 1, 2, 3, 3, 9, 9, 10, 11)]], "v int")
    assert sorted(r.v for r in select.by_range(df, "v", 0.3, 0.8).collect()) == [1, 1, 1, 2, 3, 3, 9, 9]
    assert sorted(r.v for r in select.by_range(df, "v", 0.31, 0.31).collect()) == [2]
    assert select.by_range(df.filter("v IS NULL"), "v", 0.1, 0.9).collect() == []
