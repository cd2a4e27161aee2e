"""Sharding: minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Bits of the group key that one refinement adds: at most 4096 sums a refined block come to the driver.
STEP = 12


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Indexes at which shards 1.. begin when each takes groups in order while they fit; None if they don't all fit."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        cuts.append(at)
    return np.array(cuts[:-1]) if at >= len(sizes) else None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search of the smallest capacity for which the greedy check succeeds."""
    lo, hi = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Indexes at which shards 1.. begin: no shard beyond a capacity that suffices, none empty if there are enough groups, else near equal.

    A fair share is what is left for each shard once groups above it have shards of their own; the stretch up to
    the next such group is cut into as many equal parts as it holds fair shares.
    """
    n, ends = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    reach = np.searchsorted(ends, ends[:-1] + capacity, "right") - 1
    need = np.zeros(n + 1, dtype=np.int64)  # shards that the groups from here on need
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]]
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        rest = sizes[at:]
        fair, big = rest.sum() / left, np.zeros(len(rest), bool)
        while (rest[~big] > fair).any() and (rest > fair).sum() < left:
            big = rest > fair
            fair = rest[~big].sum() / (left - big.sum())
        stop = at + int(np.argmax(big)) if big.any() else n
        equal = round((ends[stop] - ends[at]) / fair) if fair else 0
        if equal:
            goal = ends[at] + (ends[stop] - ends[at]) / equal
            to = int(np.searchsorted(ends, goal))
            to -= to > at + 1 and goal - ends[to - 1] < ends[to] - goal
        else:
            to = stop + 1
        least = int(np.searchsorted(-need, 1 - left))  # from here on the other shards suffice
        at = min(max(to, least, at + 1), int(reach[at]), max(at + 1, n - left + 1))
        if at >= n:
            break
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1.. and the exact smallest capacity over groups (key long, size long), ordered by key.

    The groups stay distributed. The driver holds sums over blocks of keys, which give a capacity that surely
    fits (blocks kept whole) and one that is surely needed (total / shards, or the largest group). Only blocks in
    which some capacity in between could cut are refined, 12 bits of the key at a time, until all such blocks
    are single groups; then the binary search over what is held is exact. Within that capacity the cuts are even.
    """
    def sums(rows: DataFrame, bits: int) -> list[tuple]:
        got = rows.groupBy(F.shiftright("key", 64 - bits).alias("b")).agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        return [(r.lo, r.s, r.lo == r.hi, bits, r.b) for r in got.collect()]

    bits = STEP
    nodes = sorted(sums(groups, bits))
    if not nodes:
        return [], 0
    while True:
        sizes = np.array([n[1] for n in nodes], dtype=np.int64)
        single = np.array([n[2] for n in nodes])
        high = smallest_capacity(sizes, shards)
        low = max(-(-int(sizes.sum()) // shards), int(sizes[single].max()) if single.any() else 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        open_, first, last = np.zeros(len(nodes), bool), 0, 0
        for _ in range(shards - 1):
            # the earliest and latest block in which this cut may lie for a capacity from low to high
            first = int(np.searchsorted(ends, ends[first] + low, "right")) - 1
            last = min(last + high, int(ends[-1]))
            first = min(first, len(nodes) - 1)
            open_[first : int(np.searchsorted(ends, last, "left")) + 1] = True
        few = len(nodes) < shards
        refine = [n for n, o, s in zip(nodes, open_, single) if (o or few) and not s]
        if not refine or (low == high and not few):
            break
        bits = max(n[3] for n in refine) + STEP
        for width in {n[3] for n in refine}:  # windows shrink, so these are almost always of one width
            blocks = [n[4] for n in refine if n[3] == width]
            rows = groups.filter(F.shiftright("key", 64 - width).isin(blocks))
            nodes = [n for n in nodes if not (n[3] == width and n[4] in set(blocks))] + sums(rows, min(64, width + STEP))
        nodes.sort()
    return [nodes[i][0] for i in even_cuts(sizes, high, shards)], high


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal documents into contiguous shards of a hash order of their texts so that the largest shard is as small as can be.

    A document's size is its UTF-8 bytes plus 1; equal texts (one group) stay together. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard. Null texts count as size 1 and as one group; an empty table gives
    no rows; repeated rows are rows of their own; other columns of docs are ignored. A group larger than
    total / shards sets the capacity by itself; the other shards share what is left nearly evenly.
    """
    scratch = Scratch(spark)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = scratch.table(docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("key"), F.xxhash64("doc_id", "text").alias("h")))
    cuts, _ = minimax_cuts(rows.select("key", "size"), shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    return ranked(rows.withColumn("shard", shard), ["shard"], "h", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
