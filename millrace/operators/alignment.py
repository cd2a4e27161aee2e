"""The passages of documents that support given texts: seeds of common words, then local alignment around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import terms

#: Bits of the filter of seeds that all tasks hold, whatever the number of seeds: false hits only cost work.
FILTER = 1 << 24
#: An alignment's value holds its score above, then where it starts in the document's part and in the given text.
SCORE, START = 43, 19
FIELDS = "score int, doc_start int, doc_end int, item_start int, item_end int"


def hashed(c: Column) -> Column:
    """64-bit hashes of a text's words, in lower case, without punctuation."""
    return F.transform(terms(c), lambda w: F.xxhash64(w))


def _seeds(words: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of every n words in a row."""
    size = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
    h = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    begin = np.cumsum(size) - size
    count = np.maximum(0, size - n + 1)
    row = np.repeat(np.arange(len(size)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    seed = np.zeros(len(row), dtype=np.uint64)
    for k in range(n):
        seed = (seed ^ h[begin[row] + place + k]) * np.uint64(0x9E3779B97F4A7C15)
        seed ^= seed >> np.uint64(29)
    return row, place, seed


def _seeded(n: int, known: np.ndarray | None) -> Callable:
    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, seed = _seeds(batch.column("words"), n)
            if known is not None:
                bit = seed >> np.uint64(40)
                on = np.flatnonzero((known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                row, place, seed = row[on], place[on], seed[on]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(seed.view(np.int64))], ["id", "place", "seed"])

    return seeded


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER // 8, dtype=np.uint8)
    for batch in batches:
        bit = batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(40)
        np.bitwise_or.at(bits, (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7))).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])


def local_alignment(x: np.ndarray, y: np.ndarray, penalty: int) -> tuple[int, int, int, int, int]:
    """(score, start and end in x, start and end in y) of the best local alignment: a match adds 1, a mismatch or gap takes `penalty`.

    Of equal scores that which ends first in x, then in y, and of those the latest start. Row by row of x; y is a row's width.
    """
    j = np.arange(len(y) + 1, dtype=np.int64)
    step = np.int64(penalty) << SCORE
    slope = j * step
    row, best = j.copy(), (0, 0, 0, 0, 0)
    for i, word in enumerate(x, 1):
        fresh = (np.int64(i) << START) | j
        cell = np.maximum(fresh, row - step)
        cell[1:] = np.maximum(cell[1:], row[:-1] + np.where(y == word, np.int64(1) << SCORE, -step))
        row = np.maximum.accumulate(cell + slope) - slope
        score = row >> SCORE
        if (top := int(score.max())) > best[0]:
            at = int(score.argmax())
            low = int(row[at]) & ((1 << SCORE) - 1)
            best = (top, low >> START, i, low & ((1 << START) - 1), at)
    return best


def parts(diagonals: np.ndarray, n_doc: int, n_item: int, penalty: int) -> list[tuple[int, int]]:
    """Ranges of a document's words that alignments through the seeds can lie in: gaps cost `penalty` each, so there are at most n_item / penalty."""
    band = n_item // penalty + 1
    out: list[tuple[int, int]] = []
    for d in np.unique(diagonals):
        low, high = max(0, int(d) - band), min(n_doc, int(d) + n_item + band)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _aligned(penalty: int, least: int) -> Callable:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, diagonals in zip(*(batch.column(c) for c in ("words", "item_words", "diagonals"))):
                x, y, diagonals = (np.asarray(v.values) for v in (x, y, diagonals))
                best = (0, 0, 0, 0, 0)
                for low, high in parts(diagonals, len(x), len(y), penalty):
                    score, a, b, c, d = local_alignment(x[low:high], y, penalty)
                    if score > best[0]:
                        best = (score, a + low, b + low, c, d)
                found.append(best)
            keep = [i for i, b in enumerate(found) if b[0] >= least]
            columns = list(zip(*(found[i] for i in keep))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "item_id")), *(pa.array(c, pa.int32()) for c in columns)], ["doc_id", "item_id", *(f.split()[0] for f in FIELDS.split(", "))])

    return aligned


def supporting(docs: DataFrame, items: DataFrame, n: int = 4, least: int = 12, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, doc_start, doc_end, item_start, item_end): the best local alignment of each document with each item, where its score is `least` or more.

    Starts and ends count words, ends are exclusive. A matching word adds 1, a mismatch or a gap takes n; so between
    two errors of an alignment that is worth its errors lie n matching words, and it shares at least least - n + 1
    runs of n words with the item: pairs with fewer are left out, no other. Keys are longs; rows without one, and
    texts of fewer than `least` words, are in no pair. All tasks hold a filter of the items' runs of fixed size; runs that pass it are joined.
    """
    spark = docs.sparkSession
    words = lambda df, key: df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), hashed(F.col(text)).alias("words")).filter(F.size("words") >= least)
    given, texts = words(items, item), words(docs, doc)
    asked = given.mapInArrow(_seeded(n, None), "id long, place int, seed long")
    known = np.zeros(FILTER // 8, dtype=np.uint8)
    for r in asked.mapInArrow(_filter, "bits binary").toLocalIterator():
        known |= np.frombuffer(r["bits"], np.uint8)
    found = texts.mapInArrow(_seeded(n, known), "id long, place int, seed long")
    met = found.join(asked.select(F.col("id").alias("item_id"), F.col("place").alias("at"), "seed"), "seed")
    met = met.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.count(F.lit(1)).alias("hits"), F.collect_set(F.col("place") - F.col("at")).alias("diagonals")).filter(F.col("hits") >= least - n + 1).checkpoint()
    pairs = texts.join(met, texts["id"] == met["doc_id"]).select("doc_id", "item_id", "diagonals", "words")
    pairs = pairs.join(given.select(F.col("id").alias("item_id"), F.col("words").alias("item_words")), "item_id")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(width, "doc_id", "item_id").mapInArrow(_aligned(n, least), f"doc_id long, item_id long, {FIELDS}")


def support_texts(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """supporting, with the words of the document that it found (support)."""
    found = supporting(docs, items, doc=doc, text=text, **how)
    cut = docs.select(F.col(doc).alias("_doc"), F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("_w"))
    return found.join(cut, F.col("doc_id") == F.col("_doc")).select(*found.columns, F.array_join(F.slice("_w", F.col("doc_start") + 1, F.col("doc_end") - F.col("doc_start")), " ").alias("support"))
