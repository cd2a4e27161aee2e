"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, ranked, text_of


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most so many buckets for which the padded total is smallest.

    best[j]: padded tokens of the first j lengths; one more bucket ends at length j and begins after i.
    """
    order = np.argsort(lengths)
    size, many = np.array(lengths, dtype=np.int64)[order], np.array(counts, dtype=np.int64)[order]
    upto = np.concatenate([[0], np.cumsum(many)])
    m = len(size)
    best = np.concatenate([[0.0], size.astype(float) * upto[1:]])
    chosen = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(min(buckets, m) - 1):
        new, at = best.copy(), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + float(size[j - 1]) * (upto[j] - upto[:j])
            at[j] = i = int(np.argmin(cost))
            new[j] = cost[i]
        best = new
        chosen.append(at)
    out, j = [], m
    for at in reversed(chosen):
        if j == 0:
            break
        out.append(int(size[j - 1]))
        j = int(at[j])
    return sorted(out)


def pack_documents(spark: SparkSession, docs: DataFrame, max_len: int = 2048, buckets: int = 8, token_budget: int = 16384, seed: int = 29) -> DataFrame:
    """Every word of every document gets a place in a batch: one row a piece of at most max_len words.

    Returns doc_id, piece, first_word, n_words, bucket_len (words a row is padded to), batch (in its bucket),
    batch_row, batch_rows, n_batches (of the bucket), padding. A batch holds token_budget // bucket_len rows.
    The driver holds the histogram of piece lengths, at most max_len rows. Null, empty and blank texts give one
    piece of no words, padded to the smallest bucket; an empty table gives no rows; rows of equal doc_id are
    separate documents; other columns of docs are ignored.
    """
    scratch = Scratch(spark)
    n = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    pieces = docs.select("doc_id", n.alias("n"), F.xxhash64("text").alias("of")).select("doc_id", "n", "of", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / max_len).cast("int") - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * max_len).alias("first_word"), F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * F.lit(max_len)).alias("n_words"), F.xxhash64(F.lit(seed), "doc_id", "of", "piece").alias("h"))
    pieces = scratch.table(pieces)
    found = pieces.groupBy(F.greatest(F.lit(1), "n_words").alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return pieces.select("doc_id", "piece", "first_word", "n_words", *(F.lit(0).cast("long").alias(c) for c in ("bucket_len", "batch", "batch_row", "batch_rows", "n_batches", "padding")))
    ends = best_boundaries([r.len for r in found], [r.n for r in found], buckets)
    bucket = F.element_at(F.filter(F.array(*map(F.lit, ends)), lambda x: x >= F.col("n_words")), 1).cast("long")
    pieces = pieces.withColumn("bucket_len", bucket)
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    sizes = pieces.groupBy("bucket_len").agg(F.count(F.lit(1)).alias("in_bucket"))
    out = ranked(pieces, ["bucket_len"], "h", extra=sizes).withColumn("batch_rows", rows)
    batch = F.floor(F.col("rank") / F.col("batch_rows"))
    return out.select("doc_id", "piece", "first_word", "n_words", "bucket_len", batch.alias("batch"), (F.col("rank") % F.col("batch_rows")).alias("batch_row"), "batch_rows", F.ceil(F.col("in_bucket") / F.col("batch_rows")).alias("n_batches"), (F.col("bucket_len") - F.col("n_words")).alias("padding"))
