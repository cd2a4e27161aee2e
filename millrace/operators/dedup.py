"""Exact and near duplicates of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.chars import fast_class
from .filters import words
from .normalize import let, strip


def exact(df: DataFrame, value: Column, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (by default all) of one row of every distinct value: that with the smallest key (rows without a key last); null is a value of its own.

    Rows are reduced to the smallest of each digest in every task before they are shuffled, so a value that a third of all rows have costs a row a task.
    """
    digest = F.md5(value).alias("_digest")
    if keep == [key]:
        return df.groupBy(digest).agg(F.min(key).alias(key)).select(key)
    names, smallest = keep or df.columns, F.struct(F.col(key).isNull(), F.col(key))
    first = df.groupBy(digest).agg(F.min_by(F.struct(*names), smallest).alias("_row"))
    return first.select(*(F.col("_row")[n].alias(n) for n in names))


def normalised(c: Column) -> Column:
    """Lower case without blanks and punctuation, for exact comparison of what is left."""
    return F.regexp_replace(F.lower(c), r"[\s\p{P}]+", "")


def segments(c: Column) -> Column:
    """The distinct stripped pieces between punctuation marks and line ends."""
    return F.array_distinct(F.transform(F.split(strip(c), fast_class(fixed.SEGMENT_ENDS)), strip))


#: Sets that share a common element are compared in blocks of so many by so many, each two blocks in a task of their own.
BLOCK = 2048
#: Stands for the segments of a null text, which is like null texts only.
NO_TEXT = 0


def segment_nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a digest of its segment set (node), and 64-bit hashes of the segments (set)."""
    found = df.select(key, F.array_sort(segments(F.col(text))).alias("_s"))
    hashes = F.coalesce(F.transform("_s", lambda x: F.xxhash64(x)), F.array(F.lit(NO_TEXT).cast("long")))
    return found.select(key, F.coalesce(F.md5(F.array_join("_s", "\u0001")), F.lit("")).alias("node"), hashes.alias("set"))


def first_of(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and set of the row with the smallest key of each node."""
    first = nodes.groupBy("node").agg(F.min(key).alias("_first"))
    return nodes.join(first, "node").filter(F.col(key) == F.col("_first")).select(key, "set").dropDuplicates([key])


def prefix_length(n: Column, limit: float) -> Column:
    """Of a set's n elements, rarest first, so many hold one at least of those that it shares with any set of which Jaccard is at least limit."""
    return n - F.ceil(n * F.lit(limit) - 1e-9).cast("int") + 1


def may_reach(na: Column, ia: Column, nb: Column, ib: Column, limit: float) -> Column:
    """Whether sets of na and nb elements, whose first common one stands at ia and ib, can have Jaccard of at least limit."""
    return (F.least(na, nb) >= limit * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) * (1 + limit) >= limit * (na + nb) - 1e-9)


def similarity(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def met_sets(sets: DataFrame, limit: float, key: str = "doc_id") -> DataFrame:
    """(a, b), a < b: sets that share an element of both prefixes and may have Jaccard of at least limit.

    Elements of one set only come first in the order of rarity and meet nothing: they are counted, and only the others are sorted.
    """
    often = sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = sets.select(key, F.size("set").alias("n"), F.explode("set").alias("s")).join(often, "s")
    ranked = shared.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("o"))
    alone = F.col("n") - F.size("o")
    ahead = prefix_length(F.col("n"), limit) - alone
    rows = ranked.filter(ahead > 0).select(key, "n", alone.alias("alone"), F.posexplode(F.slice("o", F.lit(1), F.greatest(F.lit(0), ahead))).alias("at", "e"))
    blocks = F.ceil(F.col("e.f") / BLOCK).cast("int")
    rows = rows.select(F.col(key).alias("k"), "n", (F.col("at") + F.col("alone")).alias("i"), "e.s", blocks.alias("_blocks"), F.pmod(F.xxhash64(key), blocks).cast("int").alias("_own"))
    left = rows.withColumn("_to", F.explode(F.sequence("_own", F.col("_blocks") - 1))).select(F.col("k").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), "s", F.col("_own").alias("_from"), "_to")
    right = rows.withColumn("_from", F.explode(F.sequence(F.lit(0), "_own"))).select(F.col("k").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), "s", "_from", F.col("_own").alias("_to"))
    met = left.join(right, ["s", "_from", "_to"]).filter(((F.col("_from") < F.col("_to")) | (F.col("x") < F.col("y"))) & may_reach(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy"), limit))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def set_pairs(sets: DataFrame, limit: float, key: str = "doc_id") -> DataFrame:
    """(a, b, similarity), a < b, of the sets that have Jaccard of at least limit."""
    one, two = sets.select(F.col(key).alias("a"), F.col("set").alias("x")), sets.select(F.col(key).alias("b"), F.col("set").alias("y"))
    return met_sets(sets, limit, key).join(one, "a").join(two, "b").select("a", "b", similarity(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= limit)


def segment_pairs(df: DataFrame, limit: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, similarity), a < b: documents whose segment sets have Jaccard of at least limit.

    Equal sets are one node; pairs stand for the nodes' smallest keys (members: segment_nodes). Texts are cut once;
    their sets are joined on a prefix in an order of the segments' frequencies, so that common segments seldom are candidates.
    """
    return set_pairs(first_of(segment_nodes(df, key, text).checkpoint(), key), limit, key)


#: Pairs that are left to one task at most.
TASK_PAIRS = 1 << 18


def _in_order(key: str) -> Callable:
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes of all pairs of the task, decided in order of the later one."""
        if held := list(batches):
            pairs, gone = pa.Table.from_batches(held).sort_by("b"), {}
            for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
                if a not in gone:
                    gone[b] = None
            yield pa.RecordBatch.from_arrays([pa.array(list(gone), pairs.schema.field("b").type)], [key])

    return decide


def greedily_dropped(pairs: DataFrame, key: str = "doc_id", most: int = TASK_PAIRS) -> DataFrame:
    """Keys that go when each, in order, is dropped if it is paired with an earlier one that stays; pairs are (a, b), a < b.

    While there are more pairs than one task decides (most), in each round those go that are paired with an earlier one
    that itself has no earlier one left; pairs of what has gone are left out, so a round costs what is still open.
    The pairs that are left, a number that doesn't grow with the input, are gone through in order. Only how many they are comes to the driver.
    """
    open_ = pairs.select("a", "b").checkpoint()
    dropped = open_.select(F.col("b").alias(key)).limit(0)
    while open_.count() > most:
        gone = open_.join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select(F.col("b").alias(key)).distinct().checkpoint()
        dropped = dropped.union(gone)
        open_ = open_.join(gone.select(F.col(key).alias("b")), "b", "left_anti").join(gone.select(F.col(key).alias("a")), "a", "left_anti").select("a", "b").checkpoint()
    return dropped.union(open_.coalesce(1).mapInArrow(_in_order(key), f"{key} {open_.schema['b'].dataType.simpleString()}"))


def greedy_kept(df: DataFrame, limit: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that stay when each, in order of key, is dropped if it is like one that stays. Null texts are like each other."""
    sets = first_of(segment_nodes(df, key, text).checkpoint(), key)
    dropped = greedily_dropped(set_pairs(sets, limit, key), key)
    return df.join(sets.select(key), key, "left_semi").join(dropped, key, "left_anti")


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 60) -> DataFrame:
    """key and the sign of each bit's sum over the text's words, as a bit string of a long."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), F.lit(0))).alias("w"))
    hashed = words.select(key, F.conv(F.substring(F.md5("w"), 1, 15), 16, 10).cast("long").alias("h"))
    sums = hashed.groupBy(key).agg(*(F.sum(F.getbit("h", F.lit(i)).cast("int") * 2 - 1).alias(f"b{i}") for i in range(bits)))
    return sums.select(key, sum((F.when(F.col(f"b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(bits)), F.lit(0).cast("long")).alias("simhash"))


def simhash_pairs(signed: DataFrame, most: int = 4, key: str = "doc_id", bits: int = 60, alike: int = 3) -> DataFrame:
    """(a, b, distance) between the smallest keys of distinct simhashes that differ in at most so many bits.

    Hashes are cut into most + alike blocks, of which alike at least are equal in such a pair; a hash is joined by
    every choice of alike blocks, so candidates agree in bits * alike / (most + alike) bits, not in one narrow band.
    A pair comes from the first choice in which it meets only, so none has to be made distinct.
    """
    nodes = signed.groupBy("simhash").agg(F.min(key).alias("id"))
    edges = [bits * i // (most + alike) for i in range(most + alike + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    choices = list(combinations(range(most + alike), alike))
    masked = F.array(*(F.col("simhash").bitwiseAND(F.lit(sum(masks[i] for i in c))) for c in choices))
    bands = nodes.select("id", "simhash", F.posexplode(masked).alias("band", "value"))
    left, right = bands.toDF("a", "x", "band", "value"), bands.toDF("b", "y", "band", "value")
    met = left.join(right, ["band", "value"]).filter("a < b").withColumn("z", F.col("x").bitwiseXOR(F.col("y")))
    same = [F.col("z").bitwiseAND(F.lit(m)) == 0 for m in masks]
    first = F.array_position(F.array(*(reduce(lambda p, q: p & q, (same[i] for i in c)) for c in choices)), True) - 1
    return met.filter((F.bit_count("z") <= most) & (first == F.col("band"))).select("a", "b", F.bit_count("z").alias("distance"))


def kept_of_pairs(df: DataFrame, signed: DataFrame, pairs: DataFrame, value: str = "simhash", key: str = "doc_id") -> DataFrame:
    """The rows of df that are first of their value and have no pair with an earlier one."""
    first = signed.groupBy(value).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi").join(pairs.select(F.col("b").alias(key)), key, "left_anti")


def signature_bands(bands: int, rows: int, seed: int = 11):
    """A pandas UDF: one hash for each band of the minima of an array of 64-bit hashes under multiplications by odd numbers."""
    @F.pandas_udf("array<long>")
    def banded(hashes: pd.Series) -> pd.Series:
        factor = np.random.default_rng(seed).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if not len(hashes):
            return pd.Series([], dtype=object)
        x = np.concatenate(hashes.tolist()).view(np.uint64)
        first = np.concatenate([[0], np.cumsum(hashes.map(len).to_numpy())[:-1]])
        out = np.zeros((len(hashes), bands), dtype=np.uint64)
        for i in range(bands):
            out[:, i] = i + 1
            for f in factor[i]:
                out[:, i] = (out[:, i] ^ np.minimum.reduceat(x * f, first)) * np.uint64(0x9E3779B97F4A7C15)
        return pd.Series(list(out.view(np.int64)))

    return banded


def minhash_groups(df: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text", bands: int = 16, rows: int = 8) -> DataFrame:
    """(id, graph_id): documents that share a band of their MinHash signatures, and the smallest key that such bands lead to.

    Bands meet with a chance of 1 - (1 - J ** rows) ** bands for Jaccard J of n-word shingle sets: one half at 0.7,
    0.98 at 0.85. A bucket's members are joined to its smallest key only, never in pairs. Texts of fewer words are
    one shingle, texts without words are in no group, and so are documents that share no band.
    """
    from ..plans.catalog import lineage

    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    found = df.select(key, words(F.lower(text)).alias("w")).filter(F.size("w") > 0).select(key, let(F.col("w"), runs).alias("s"))
    met = found.select(F.col(key).alias("b"), F.explode(signature_bands(bands, rows)(F.col("s"))).alias("band")).checkpoint()
    hubs = met.groupBy("band").agg(F.min("b").alias("a"))
    return lineage(df.sparkSession, met.join(hubs, "band").select("a", "b"))


def minhash_kept(df: DataFrame, key: str = "doc_id", **how: object) -> DataFrame:
    """The first document of every group of minhash_groups, and all that are in none."""
    gone = minhash_groups(df, key=key, **how).filter("id != graph_id").select(F.col("id").alias(key))
    return df.join(gone, key, "left_anti")
