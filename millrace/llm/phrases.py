"""Collocations: n-grams are routed to their rarest word, mined there, and scored by their most doubtful cut."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, text_of
from .tokens import _LOWER, mix, slices, words

LONGEST = 4
#: Words of a fragment on either side of its pivot.
SIDE = LONGEST - 1
#: The table of how common words are has so many cells of two bytes, whatever the vocabulary; words of one cell count as equally common.
CELLS = 1 << 22
#: Steps of the logarithm (base 2) of a cell's count.
STEPS = 1000
#: Fragments that a task combines before it hands them on.
HELD = 1 << 19
#: Fragments that a task mines together, or those of one key where these are more.
AT_ONCE = 1 << 17
#: A word that has more than one of FAIR * (shuffle partitions) equal parts of all words is a pivot in several tasks.
FAIR = 4
#: No word is dealt to several tasks for fewer occurrences, and no part of a phrase is sent to all tasks for fewer that ask for it.
FEW, FEW_ASKS = 1 << 14, 1000

_PIECE = np.zeros(256, dtype=bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True


def _lang_keys(langs: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the languages of a batch, and each row's place in them and 64-bit key."""
    found = langs.dictionary_encode()
    names = found.dictionary.to_pylist()
    at = found.indices.to_numpy(zero_copy_only=False)
    keys = np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in names], dtype=np.uint64)
    return names, at, keys[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the words of each cell occur (lang null), and all words of each language (cell null)."""
    cells, every = np.zeros(CELLS, dtype=np.int64), {}
    for batch in batches:
        names, at, key = _lang_keys(batch.column("lang"))
        for lo, hi, off, data in slices(batch.column("text")):
            _, _, row, h = words(off, data, _BETWEEN)
            np.add.at(cells, (mix(h ^ key[lo + row]) >> np.uint64(42)).astype(np.int64), 1)
            for i, n in enumerate(np.bincount(at[lo + row], minlength=len(names))):
                every[names[i]] = every.get(names[i], 0) + int(n)
    some = np.flatnonzero(cells)
    langs = list(every)
    for lo in range(0, len(some), 1 << 16):
        part = some[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part.astype(np.int32)), pa.array(cells[part])], ["lang", "cell", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.int32()), pa.array([every[s] for s in langs], pa.int64())], ["lang", "cell", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        level = np.rint(np.log2(batch.column("n").to_numpy()) * STEPS).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("cell").to_numpy().tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary())], ["cells", "levels"])


def common_words(counted: DataFrame, least: int) -> np.ndarray:
    """The table of two bytes a cell: 0 where a cell's words are too rare together, else the logarithm of their count."""
    levels = np.zeros(CELLS, dtype=np.uint16)
    for r in counted.filter((F.col("n") >= least) & F.col("cell").isNotNull()).mapInArrow(_packed, "cells binary, levels binary").toLocalIterator():
        levels[np.frombuffer(r["cells"], np.int32)] = np.frombuffer(r["levels"], np.uint16)
    return levels


def _beside(ok: np.ndarray) -> np.ndarray:
    """Of every word, how many words lie in an unbroken row on one side of it that its fragment may take in."""
    out = np.zeros(ok.shape[1], dtype=np.int64)
    for d in range(SIDE):
        out += (out == d) & ok[d]
    return out


def fragments(off: np.ndarray, data: np.ndarray, key: np.ndarray, levels: np.ndarray) -> tuple:
    """Every common word with the common words around it that are no rarer, as far as n-grams reach that it is the pivot of.

    An n-gram's pivot is its rarest word, the leftmost of equal ones. So words on the left must be more common, those
    on the right at least as common; what is rarer, or in another piece, ends the fragment. Every n-gram of common words
    then lies around the pivot of one fragment.
    Returns rows, keys of the pivots, places of the pivots, hashes, starts and ends in text, and text: words and blanks.
    """
    starts, ends, row, h = words(off, data, _BETWEEN)
    piece = np.cumsum(_PIECE[data])[starts] + row if len(starts) else starts
    h = mix(h ^ key[row])
    level = levels[(h >> np.uint64(42)).astype(np.int64)]
    rank = (level.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    n = len(h)
    left, right = np.zeros((SIDE, n), dtype=bool), np.zeros((SIDE, n), dtype=bool)
    for d in range(1, min(SIDE, n - 1) + 1):
        together = piece[d:] == piece[:-d]
        left[d - 1, d:] = together & (rank[:-d] > rank[d:])
        right[d - 1, :-d] = together & (rank[d:] >= rank[:-d])
    before, after = _beside(left), _beside(right)
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    text = np.full(int(size.sum()) + n, 32, dtype=np.uint8)
    inside = np.arange(int(size.sum()))
    skipped = np.repeat(np.arange(n), size)
    text[inside + skipped] = _LOWER[data[inside + np.repeat(starts - (np.cumsum(size) - size), size)]]
    i = np.flatnonzero(level)
    first, last = i - before[i], i + after[i]
    print_ = h[i] + before[i].astype(np.uint64)
    for d in range(1, SIDE + 1):
        for near, has in ((i - d, before[i] >= d), (i + d, after[i] >= d)):
            print_ = mix(print_ * np.uint64(0x9E3779B97F4A7C15) + np.where(has, h[np.clip(near, 0, max(0, n - 1))], np.uint64(d)))
    return row[i], h[i], before[i], print_, at[first], at[last] + size[last], text


def cut(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of a buffer of bytes as strings."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    took = text[np.arange(off[-1]) + np.repeat(starts - off[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(took)])


class Combined:
    """Equal fragments of a task, counted."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, *part: object) -> None:
        self.parts.append(part)
        self.rows += len(part[0])

    def take(self) -> tuple | None:
        if not self.rows:
            return None
        *columns, texts, langs = zip(*self.parts)
        prints, n, pivot, at = (np.concatenate(c) for c in columns)
        texts, langs = pa.chunked_array(texts), pa.chunked_array(langs)
        self.parts, self.rows = [], 0
        _, first, of = np.unique(prints, return_index=True, return_inverse=True)
        count = np.bincount(of, weights=n).astype(np.int64)
        rows = pa.array(first)
        return prints[first], count, pivot[first], at[first], texts.take(rows).combine_chunks(), langs.take(rows).combine_chunks()


def _routed(levels: np.ndarray, fair: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            if (got := held.take()) is not None:
                prints, n, pivot, at, texts, langs = got
                often = np.exp2(levels[(pivot >> np.uint64(42)).astype(np.int64)] / STEPS)
                tasks = np.ceil(often / fair).astype(np.uint64)
                key = mix(pivot + (prints >> np.uint64(8)) % tasks)
                columns = [pa.array(key.view(np.int64)), pa.array(tasks > 1), langs, pa.array(at.astype(np.int8)), texts.cast(pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "shared", "lang", "at", "words", "n"])

        held = Combined()
        for batch in batches:
            names, place, key = _lang_keys(batch.column("lang"))
            for lo, hi, off, data in slices(batch.column("text")):
                row, pivot, at, prints, start, end, text = fragments(off, data, key[lo:hi], levels)
                _, first, n = np.unique(prints, return_index=True, return_counts=True)
                lang = pa.array(names, pa.string()).take(pa.array(place[lo + row[first]])) if len(first) else pa.array([], pa.string())
                held.add(prints[first], n, pivot[first], at[first], cut(text, start[first], end[first]), lang)
                if held.rows >= HELD:
                    yield from out()
        yield from out()

    return route


def mined(table: pa.Table, least: int) -> pa.Table:
    """The n-grams that fragments' pivots own, pivots alone among them: complete keys give those of at least `least`, shared ones all, to be summed."""
    key, shared, at, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "shared", "at", "n"))
    texts = table.column("words").combine_chunks()
    out = []
    for lo, hi, off, data in slices(texts, 1 << 62):
        starts, ends, row, h = words(off, data)
        begin = np.searchsorted(row, np.arange(hi - lo))
        count = np.bincount(row, minlength=hi - lo)
        grams: list[tuple] = []
        for first in range(LONGEST):
            hashed = np.zeros(hi - lo, dtype=np.uint64)
            for size in range(1, LONGEST + 1):
                on = np.flatnonzero(first + size <= count)
                if not len(on):
                    break
                last = begin[on] + first + size - 1
                hashed[on] = mix(hashed[on] * np.uint64(0x9E3779B97F4A7C15) + h[last] + np.uint64(size))
                own = (first <= at[on]) & (at[on] < first + size)
                f = on[own]
                grams.append((hashed[f] ^ mix(key[f].view(np.uint64)), f, starts[begin[f] + first], ends[begin[f] + first + size - 1], np.full(len(f), size, dtype=np.int8)))
        hashed, f, start, end, size = (np.concatenate(c) for c in zip(*grams))
        _, first, of = np.unique(hashed, return_index=True, return_inverse=True)
        a = np.bincount(of, weights=n[f]).astype(np.int64)
        stay = np.flatnonzero((a >= least) | shared[f[first]])
        first = first[stay]
        langs = table.column("lang").combine_chunks().take(pa.array(f[first]))
        out.append(pa.table([langs, cut(data, start[first], end[first]).cast(pa.string()), pa.array(size[first]), pa.array(a[stay])], ["lang", "phrase", "words", "a"]))
    return pa.concat_tables(out)


def _mine(least: int):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, so that no more is held than the fragments of a few keys."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= AT_ONCE:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                if whole := int(np.searchsorted(key, key[-1])):
                    yield from mined(table.slice(0, whole), least).to_batches()
                    held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield from mined(pa.Table.from_batches(held), least).to_batches()

    return mine


def phrase_counts(spark: SparkSession, docs: DataFrame, scratch: Scratch, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of one to four words that occur at least `least` times in their language, and (lang, n) of all words.

    Two passes over the texts: one counts how common words are, one cuts them into fragments, which go to their
    pivots. The fragments of a very common pivot are dealt to several tasks, whose counts are summed afterwards.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    counted = scratch.table(texts.mapInArrow(_counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    every = counted.filter("cell IS NULL AND n > 0").select("lang", "n")
    levels = common_words(counted, least)
    total = every.agg(F.sum("n")).first()[0] or 0
    fair = max(FEW, total // (FAIR * parts(spark)))
    routed = texts.mapInArrow(_routed(levels, fair), "key long, shared boolean, lang string, at byte, words string, n long")
    sorted_ = routed.repartition(parts(spark), "key").sortWithinPartitions("key")
    found = sorted_.mapInArrow(_mine(least), "lang string, phrase string, words byte, a long")
    return scratch.table(found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)), every


def _runs(first: Column, size: Column | int) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def looked_up(asked: DataFrame, counts: DataFrame, spark: SparkSession) -> DataFrame:
    """asked (lang, part, ...) with f of the part. Parts that very many ask for, of which there can only be FAIR * partitions, go to all tasks."""
    asks = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("_asks"))
    total = asks.agg(F.sum("_asks")).first()[0] or 0
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    many = asks.filter(F.col("_asks") > max(FEW_ASKS, total // (FAIR * parts(spark)))).select("lang", "part")
    many = F.broadcast(known.join(many, ["lang", "part"], "left_semi"))
    return asked.join(many, ["lang", "part"]).unionByName(asked.join(many, ["lang", "part"], "left_anti").join(known, ["lang", "part"]))


def mine_phrases(spark: SparkSession, docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of two to four words.

    Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends; words are what blanks and tabs leave. A phrase
    occurs a times, at least `least`. Its score is floor(2000000 * a / (l + r)) at the cut, into parts that occur l and r
    times, where that is lowest, the first of such; phrases inside a longer one that occurs `inside` percent as often are left out.
    Null texts are empty, a null lang is `und`, repeated rows count as often as they come, texts of any length are cut
    whole; ties of score go by a, then by the phrase's bytes. Only lang and text are read, so other columns may have any
    name. An empty table has no phrases.
    """
    scratch = Scratch(spark)
    counts, every = phrase_counts(spark, docs, scratch, least)
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w"))
    longer = phrases.filter("words > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words").cast("int") - 1)).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("first"))
    longer = longer.select("lang", "a", _runs(F.col("first"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    swallowed = F.coalesce(wide("_longer") * 100 >= wide("a") * inside, F.lit(False))
    left = scratch.table(phrases.join(longer, ["lang", "phrase"], "left").filter(~swallowed).select("lang", "phrase", "a", "w"))
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("is_first"), _runs(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("is_first"), _runs(F.col("k") + 1, F.size("w")).alias("part")))
    asked = scratch.table(cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("_s")).select("lang", "phrase", "a", "k", "_s.is_first", "_s.part"))
    both = looked_up(asked, counts, spark).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r"))
    score = F.expr("(2000000BD * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
    # the first of each slice of a language, then of fewer slices, so that no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = lowest.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(parts(spark))))
    for fewer in (1, math.ceil(parts(spark) ** 0.5)):
        some = some.withColumn("_slice", F.floor(F.col("_slice") / fewer)).withColumn("rank", place("lang", "_slice")).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", place("lang").cast("long")).filter(F.col("rank") <= top)
    return ranked.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
