"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, ranked, text_of

#: Words left of a budget from which the exact dynamic program takes over, at least; twice the longest document's if that is more.
DP_WORDS = 8192


def targets(sizes: list[int], weights: list[float], total_share: float = 1.5, most: float = 2.0) -> list[float]:
    """Share total_share of all sizes by weight; no target above most times its size, the excess shared again by weight."""
    out, left, active = [0.0] * len(sizes), total_share * sum(sizes), list(range(len(sizes)))
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        active = [i for i in active if i not in set(full)]
    return out


def fit_budget(lengths: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near below the budget as can be.

    Every length first gives the same share of its documents, rounded down; the largest fractions add one more
    document each while over dp_words, or two of the longest documents, remain; the rest is an exact bounded knapsack
    over the remaining words and all documents not taken (bit sets of reachable sums, counts split into powers of two).
    """
    dp_words = max(dp_words, 2 * max(lengths, default=0))
    total = sum(n * c for n, c in zip(lengths, counts))
    budget = min(budget, total)
    if budget <= 0 or not total:
        return [0] * len(lengths)
    take = [budget * c // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: (-(budget * counts[i] % total), lengths[i])):
        if take[i] < counts[i] and rest - lengths[i] >= dp_words:
            take[i] += 1
            rest -= lengths[i]
    items, sums, mask = [], [1], (1 << (rest + 1)) - 1
    for i, n in sorted(enumerate(lengths), key=lambda x: -x[1]):
        left, k = min(counts[i] - take[i], rest // n if n else 0), 1
        while left > 0 and not sums[-1] >> rest & 1:
            k = min(k, left)
            items.append((i, k))
            sums.append((sums[-1] | sums[-1] << (n * k)) & mask)
            left, k = left - k, k * 2
    at = sums[-1].bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(sums[:-1])):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole passes and extra documents for each length of one source, from its histogram and target."""
    rows = rows.sort_values("size").reset_index(drop=True)
    target, size = float(rows.target[0]), int((rows["size"] * rows.n).sum())
    passes = min(2, int(target // size)) if size else 0
    counts = rows.n.tolist() if passes < 2 else [0] * len(rows)
    take = fit_budget(rows["size"].tolist(), counts, int(target - passes * size))
    return pd.DataFrame({"skey": rows.skey, "size": rows["size"], "source_size": size, "target": target, "passes": passes, "take": take})


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document goes into the mix: doc_id, size, source_size, target, taken, times, and the columns in keep.

    Sources in code-point order (null last) take the weights in turn. Times is 0, 1 or 2: whole passes over a
    source, plus one for the first documents of each length in seeded hash order, as many as the knapsack says.
    Null or empty texts have size 0 and are never extra; an empty table gives no rows; documents of equal
    doc_id are separate rows, told apart by their texts, so reruns agree; equal rows are alike in all but which of
    them is taken. The driver holds one row a source, and tasks one histogram row a source and length.
    """
    scratch = Scratch(spark)
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z"))
    rows = docs.select("doc_id", skey.alias("skey"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *keep)
    if not keep:
        rows = scratch.table(rows)
    lengths = scratch.table(rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")))
    found = sorted((r.skey.encode(), r.skey, r.s) for r in lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect())
    goals = targets([s for _, _, s in found], [weights[i % len(weights)] for i in range(len(found))])
    goal = spark.createDataFrame([(k, float(t)) for (_, k, _), t in zip(found, goals)], "skey string, target double")
    plan = lengths.join(goal, "skey").groupBy("skey").applyInPandas(plan_source, "skey string, size long, source_size long, target double, passes int, take long")
    plan = scratch.table(plan)
    times = (F.col("passes") + (F.col("rank") < F.col("take")).cast("int")).alias("times")
    return ranked(rows, ["skey", "size"], "h", extra=plan).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times, *keep)
