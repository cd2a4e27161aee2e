"""Lexical, dense and hybrid retrieval."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import let


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of every document that holds a query term; idf = ln(1 + (N - n + 0.5) / (n + 0.5)).

    Only the query's terms leave a document, with their counts; length and number of documents are one small aggregate.
    """
    wanted = sorted(set(query.lower().split()))
    t = df.select(key, terms(F.col(text)).alias("t"))
    whole = t.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean"))
    hits = t.select(key, F.size("t").alias("len"), F.explode(F.filter("t", lambda x: x.isin(*wanted))).alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    scored = hits.join(F.broadcast(df_), "term").join(F.broadcast(whole))  # at most a row a query term, and one row
    idf = F.log(1 + (F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))


def okapi(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """key and Okapi score of every document that holds a query term; idf = ln(N - n + 0.5) - ln(n + 0.5), a negative one becomes floor times the mean idf of all terms.

    Terms are counted in each document first; the terms' document frequencies are one shuffle of distinct terms a task.
    """
    wanted = sorted(set(query.lower().split()))
    t = df.select(key, terms(F.col(text)).alias("t"))
    whole = t.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean"))
    every = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(F.col("docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    weights = every.join(whole).select("term", idf.alias("idf"))
    low = weights.agg((floor * F.avg("idf")).alias("low"))
    hits = t.select(key, F.size("t").alias("len"), F.explode(F.filter("t", lambda x: x.isin(*wanted))).alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = hits.join(weights.filter(F.col("term").isin(*wanted)), "term").join(whole).join(low)
    part = F.when(F.col("idf") >= 0, F.col("idf")).otherwise(F.col("low")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))


def counted(values: Column) -> Column:
    """The distinct values of an array, in order, as (term, tf); it is sorted, so that equal ones are neighbours."""
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    runs = lambda s: let(starts(s), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).alias("tf"))))
    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, runs(s)))


def keywords(df: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, term, score) of each text's k terms of largest tf * ln(N / n); ties by term.

    Terms are counted within their text and dealt by term once: there the rows of one key are summed, its keys
    counted and scores made; only what is among a task's k best of a key is dealt by key.
    """
    each = df.select(key, F.explode(counted(terms(F.col(text)))).alias("_c")).select(key, "_c.*").repartition("term")
    counts = each.groupBy("term", key).agg(F.sum("tf").alias("tf"))
    often = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("n"))  # always: it reads the same columns, and so the same shuffle
    docs = df.agg(F.count(F.lit(1)).alias("docs"))
    scored = counts.join(often, "term").join(F.broadcast(docs)).select(key, "term", F.round(F.col("tf") * F.log(F.col("docs") / F.col("n")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def okapi_scores(texts: list[list[str]], k1: float = 1.5, b: float = 0.75) -> Callable[[int, int], float]:
    """score(i, j) of text j for the words of text i, among a few texts; negative idf becomes a quarter of the mean idf."""
    counts = [Counter(t) for t in texts]
    mean = sum(map(len, texts)) / max(1, len(texts))
    n = Counter(w for c in counts for w in c)
    idf = {w: math.log(len(texts) - k + 0.5) - math.log(k + 0.5) for w, k in n.items()}
    floor = 0.25 * sum(idf.values()) / max(1, len(idf))
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}

    def part(c: Counter, size: int) -> dict[str, float]:
        length = k1 * (1 - b + b * size / mean) if mean else k1
        return {w: idf[w] * k * (k1 + 1) / (k + length) for w, k in c.items()}

    parts = [part(c, len(t)) for c, t in zip(counts, texts)]

    def score(i: int, j: int) -> float:
        of = parts[j]
        return sum(of[w] for w in texts[i] if w in of)

    return score


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and cosine of every vector with the query."""
    return df.select(key, cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))).alias("score"))


def mean_similarity(vector: Column, probes: list[list[float]]) -> Column:
    """The mean cosine of a vector with all probes (a validation set of few vectors)."""
    each = [cosine(vector, F.array(*(F.lit(float(x)) for x in p))) for p in probes]
    return sum(each[1:], each[0]) / len(each)


def top(df: DataFrame, k: int, key: str) -> DataFrame:
    return df.orderBy(F.desc("score"), key).limit(k)


def scaled(df: DataFrame) -> DataFrame:
    """Scores moved to 0..1 by their least and largest; equal scores become 1."""
    w = Window.partitionBy()
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, key: str, weights: tuple[float, float] = (0.1, 0.9), least: float = 0.0) -> DataFrame:
    """The two lists' k best each, scaled, and summed by weight: key and score of at least `least`, best first. Both lists have at most k rows."""
    a = scaled(top(dense, k, key)).select(key, F.col("score").alias("dense"))
    b = scaled(top(sparse, k, key)).select(key, F.col("score").alias("sparse"))
    both = a.join(b, key, "full").select(key, (weights[0] * F.coalesce("dense", F.lit(0.0)) + weights[1] * F.coalesce("sparse", F.lit(0.0))).alias("score"))
    return both.filter(F.col("score") >= least)
