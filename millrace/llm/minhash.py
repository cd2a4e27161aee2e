"""Document fingerprints: MinHash by universal hash permutations in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, text_of
from .ngram_join import signed_join
from .tokens import mix, shingles, slices, words

PERMUTATIONS, SHINGLE = 128, 5
#: Texts of at most so many bytes are hashed at once, so that a permutation's values stay in the CPU's cache.
CHUNK = 1 << 19
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long, component_id long"


def permutations(n: int = PERMUTATIONS, seed: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of x -> a * x + b modulo 2**32, each a permutation of the 32-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(texts: pa.Array, a: np.ndarray, b: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A row of minima for each text; texts without words have the largest value everywhere."""
    out = np.full((len(texts), len(a)), 0xFFFFFFFF, dtype=np.uint32)
    for lo, _, off, data in slices(texts, CHUNK):
        _, _, rows, h = words(off, data)
        rows, h = shingles(rows, h, n)
        if not len(h):
            continue
        x = (h >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        at = lo + rows[first]
        for j in range(len(a)):
            out[at, j] = np.minimum.reduceat(a[j] * x + b[j], first)
    return out


def hexes(sig: np.ndarray) -> list[str]:
    """The low 16 bits of every minimum; equality of minima is what likeness counts."""
    low = sig.astype(">u2")
    return [r.tobytes().hex() for r in low]


def likeness(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p.astype(np.uint16) == q.astype(np.uint16)).mean(axis=1)


DEALT = "doc_id long, _of long, bucket int, follows int, kind int, n_shingles long, component long, body binary"


def _tops(splits: np.ndarray) -> Callable:
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The highest id of each bucket in a batch; buckets are told by how many of the sorted splits are at most the id."""
        for batch in batches:
            ids = np.sort(batch.column("_id").to_numpy())
            bucket = np.searchsorted(splits, ids, "right")
            last = np.flatnonzero(np.diff(bucket, append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[last], pa.int32()), pa.array(ids[last])], ["b", "top"])

    return tops


def _packed(splits: np.ndarray, tops: np.ndarray, closes: np.ndarray) -> Callable:
    """Rows by bucket, texts compressed one by one, as all of them are shuffled; a row whose id is a bucket's highest also closes the bucket above. Rows of kind 0 have no texts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        names = [f.split()[0] for f in DEALT.split(", ")]
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            kind = np.full(len(ids), int("text" in batch.schema.names))
            none = pa.nulls(len(ids), pa.int64())
            body = pa.nulls(len(ids), pa.binary())
            if kind.any():
                body = pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in batch.column("text").cast(pa.binary())], pa.binary())
            size, component = (batch.column(c) if c in batch.schema.names else none for c in ("n_shingles", "component_id"))
            bucket = np.searchsorted(splits, ids, "right")
            at = np.minimum(np.searchsorted(tops, ids), max(0, len(tops) - 1))
            again = np.flatnonzero((kind > 0) & (tops[at] == ids)) if len(tops) else np.zeros(0, np.int64)
            for rows, where, follows in ((np.arange(len(ids)), bucket, 0), (again, closes[at[again]] if len(again) else again, 1)):
                if len(rows):
                    take = lambda c: c.take(pa.array(rows))  # noqa: E731, B023
                    cols = [take(batch.column("doc_id")), take(batch.column("_of")), pa.array(where, pa.int32()), pa.array(np.full(len(rows), follows), pa.int32()), pa.array(kind[rows], pa.int32()), take(size), take(component), take(body)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return packed


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and falling doc_id, each bucket closed by the document that follows it; a row without a text tells the component of the rows of its doc_id and text that come next."""
    a, b = permutations()
    unpress = zstandard.ZstdDecompressor()
    held: pa.Table | None = None
    held_sig = np.zeros((0, len(a)), dtype=np.uint32)
    told = (0, None)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for batch in batches:
        text = batch.column("kind").to_numpy() == 1
        size, component = batch.column("n_shingles").to_pylist(), batch.column("component").to_pylist()
        last = np.maximum.accumulate(np.where(text, -1, np.arange(len(text))))
        found = [(size[i], component[i]) if i >= 0 else told for i in last]
        told = found[-1] if found else told
        at = np.flatnonzero(text)
        bodies = batch.column("body").take(pa.array(at))
        new = pa.table({"doc_id": batch.column("doc_id").take(pa.array(at)), "bucket": batch.column("bucket").take(pa.array(at)), "follows": batch.column("follows").take(pa.array(at)), "text": pa.array([unpress.decompress(x.as_buffer()).decode() if x.is_valid else "" for x in bodies], pa.large_string()), "n_shingles": pa.array([found[i][0] for i in at], pa.int64()), "component_id": pa.array([found[i][1] for i in at], pa.int64())})
        sig = np.vstack([held_sig, signatures(new.column("text"), a, b)])
        rows = new if held is None else pa.concat_tables([held, new])
        if not rows.num_rows:
            continue
        held, held_sig = rows.slice(rows.num_rows - 1), sig[-1:]
        flag, bucket = rows.column("follows").to_numpy(), rows.column("bucket").to_numpy()
        own = np.flatnonzero((flag[:-1] == 0) & (bucket[:-1] == bucket[1:]))
        if not len(own):
            continue
        texts = rows.column("text").to_pylist()
        edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i in own for t in (texts[i],)]
        new_sig = signatures(pa.array(edited, pa.large_string()), a, b)
        take = lambda c: rows.column(c).take(pa.array(own)).combine_chunks()  # noqa: E731, B023
        cols = [take("doc_id"), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexes(sig[own])), pa.array(hexes(new_sig)), pa.array(likeness(sig[own], new_sig)), pa.array(likeness(sig[own], sig[own + 1])), take("n_shingles"), take("component_id")]
        yield pa.RecordBatch.from_arrays(cols, names)


def fingerprint_documents(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """Each document's fingerprint, that of its text with the second half taken from the next document, and its near duplicates.

    The next document is found without one global sort: doc_ids are cut into ranges of about equal counts, and
    each range also gets the first document of the range below (the lowest gets the highest document of all).
    component_id and n_shingles are those of near_duplicates. Null texts are empty; texts of fewer than five words are
    one shingle; texts without words share one fingerprint and are like each other, but are in no component. Rows of
    equal doc_id follow each other by a hash of their texts, rows without one are the lowest. An empty table gives no
    rows. Other columns are ignored.
    """
    n = 3 * parts(spark)
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text_of()).alias("_of"))
    near = near_duplicates(spark, docs, percent=percent, keep=("_id", "_of"))
    ids = docs.select("_id")
    found = ids.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 20 * n).alias("p")).first().p
    splits = np.array(sorted(set(found or [])), np.int64)
    tops = sorted((r.b, r.top) for r in ids.mapInArrow(_tops(splits), "b int, top long").groupBy("b").agg(F.max("top").alias("top")).collect())
    above = sorted((top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops))
    dealt = _packed(splits, np.array([t for t, _ in above], np.int64), np.array([b for _, b in above], np.int64))
    texts = docs.select("text", "doc_id", "_id", "_of").mapInArrow(dealt, DEALT)
    told = near.select("doc_id", "_id", "_of", "n_shingles", "component_id").mapInArrow(dealt, DEALT)
    rows = texts.union(told).repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "follows", F.desc("doc_id"), "_of", "kind")
    return rows.mapInArrow(_edited, FIELDS)


def banded(rows: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of a band) for every band of width minima of the sets given as hashes by row."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = permutations()
    bands = len(a) // width
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(first), 1))
    for i in range(bands):
        for j in range(i * width, (i + 1) * width):
            out[:, i] = mix(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(a[j] * x + b[j], first) + np.uint64(1))
    return np.repeat(rows[first], bands), out.ravel()


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = SHINGLE, percent: int = 80, rows: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and the columns in keep: documents that share a band of their signatures and whose Jaccard is verified link.

    128 permutations make 25 bands of 5 rows: sets of Jaccard 0.8 share one with a chance of 0.9999. A band's
    documents meet through its smallest set, never in pairs; equal sets are one node however many documents have
    them. The Jaccard of n-word shingle sets is then taken exactly inside each cluster. Null, empty and
    blank texts link with nothing; repeated rows give a row each; an empty table gives none; other columns are ignored.
    """
    return signed_join(spark, docs, n, percent, lambda of, h, size: banded(of, h, rows), keep)
