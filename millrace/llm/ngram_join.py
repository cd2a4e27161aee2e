"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow_batches, parts
from .tokens import mix
from .verify import SHORT, bands, link_components, set_keys, set_rows

#: Signatures that a task holds before it sends them on.
HELD = 1 << 20
#: Shingles whose signatures one bucket has on average, some 12 MB, and how many buckets there are at least: the more there
#: are, the fewer signatures of a node meet in one, whose bytes then differ less between small inputs and large ones.
BUCKET, BUCKETS = 1 << 19, 256
#: Signatures of at most so many elements are left out where no link can be lost.
LIGHT = 4
#: Signatures are made anew and met in so many turns, each of an equal share of all, so that the disk holds a share at once.
TURNS = 2


def signatures(rows: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets given as sorted hashes by row.

    Linked sets of a band with sizes up to u differ in at most k = 2u (100 - percent) / (100 + percent) elements.
    The hash domain is cut into n1 = ceil((k + 1) / 2) parts, so some part has at most one difference; each part
    is cut into n2 cells, and the signatures of a part are its subsets of n2 - 1 cells: one of them leaves out
    the cell with the difference and is equal for both sets. With k = 0 only equal sets link. A set signs for its
    own band and, as the smaller partner, for the next.

    A sixth more parts than needed are made, so t + 1 of them have at most one difference. Signatures of few elements
    would join sets that have nothing else in common, so a set leaves out all those of at most c elements, for the
    largest c up to LIGHT for which no more than t of its parts have such. No link is lost: of two linked sets take the one
    of larger c; some part with at most one difference has no such signature, and the one both share there has more
    than c elements, so that neither left it out.
    """
    out_rows, out = [], []
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lows = bands(percent, int(size.max()))
    own = np.searchsorted(lows, size, "right") - 1
    value = mix(h + np.uint64(0x2545F4914F6CDD1D))
    top = (h >> np.uint64(32))
    for step in (0, 1):
        band = own + step
        k = 2 * (lows[band + 1] - 1) * (100 - percent) // (100 + percent)
        use = (size > 0) & (k > 0) & ((step == 0) | (100 * size // percent >= lows[band]))
        n1 = np.where(use, (k + 2) // 2 + (k + 2) // 12, 0)
        n2 = np.where((k <= 8) | (percent < 85), 4, np.where(k <= 24, 3, 2))
        cells = n1 * n2
        start = np.concatenate([[0], np.cumsum(cells)])
        if not start[-1]:
            continue
        on = use[rows]
        r = rows[on]
        cell = start[r] + ((top[on] * cells[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(start[-1], dtype=np.uint64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))  # hashes are sorted, so are cells
        sums[cell[first]] = np.add.reduceat(value[on], first)
        row = np.repeat(np.arange(len(size)), cells)
        local = np.arange(start[-1]) - start[row]
        part_first = np.flatnonzero(local % n2[row] == 0)
        width = n2[row][part_first]
        whole = np.repeat(np.add.reduceat(sums, part_first), width)
        salt = mix((band[row].astype(np.uint64) << np.uint64(40)) + local.astype(np.uint64) + np.uint64(1))
        held = np.bincount(cell, minlength=start[-1])
        in_part = np.add.reduceat(held, part_first)
        least = in_part - np.maximum.reduceat(held, part_first)  # elements of the part's lightest signature
        light = np.full(len(size), -1)
        for c in range(LIGHT + 1):
            few = np.bincount(row[part_first], weights=least <= c, minlength=len(size))
            light = np.where(few <= n1 - k // 2 - 1, c, light)
        keep = np.repeat(in_part, width) - held > light[row]
        out_rows.append(row[keep])
        out.append(mix((whole - sums) ^ salt)[keep])
    return (np.concatenate(out_rows), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures once each with their smallest node, and an edge to it from every other node of the signature."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    lead = node[new][np.cumsum(new) - 1]
    edge = ~new & (lead != node)
    return sig[new], node[new], lead[edge], node[edge]


def packed(sig: np.ndarray, node: np.ndarray) -> tuple[bytes, bytes]:
    """Five bytes of each signature (if unequal ones meet so, they are compared in vain), and runs of up to 255 equal short nodes, of five bytes, too."""
    begins = np.concatenate([[True], node[1:] != node[:-1]])
    at = np.flatnonzero(begins)
    first = np.flatnonzero(begins | ((np.arange(len(node)) - np.repeat(at, np.diff(np.append(at, len(node))))) % 255 == 0))
    runs = np.diff(np.append(first, len(node))).astype(np.uint8)
    short = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return short(sig), short(node[first]) + runs.tobytes()


def unpacked(sig: bytes, node: bytes) -> tuple[np.ndarray, np.ndarray]:
    def whole(short: np.ndarray) -> np.ndarray:
        out = np.zeros((len(short) // 5, 8), dtype=np.uint8)
        out[:, :5] = short.reshape(-1, 5)
        return out.view("<u8").ravel().astype(np.uint64)

    n = len(node) // 6
    return whole(np.frombuffer(sig, np.uint8)), whole(np.frombuffer(node, np.uint8, 5 * n)).repeat(np.frombuffer(node, np.uint8, n, 5 * n))


def _sign(n: int, signer: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], buckets: int, turn: int = 0, turns: int = 1) -> Callable:
    def rows_of(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Nodes that share a signature here go out as edges; others may meet them only through its smallest node."""
        sig, node, a, b = stars(sig, node & np.uint64(SHORT))
        sig, to = sig // np.uint64(buckets), (sig % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((node, to))
        sig, node, to = sig[order], node[order], to[order]
        cut = np.searchsorted(to, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [(int(i), *packed(sig[cut[i] : cut[i + 1]], node[cut[i] : cut[i + 1]])) for i in some]
        if len(a):
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            # spread over the buckets' tasks, marked by having no signatures
            blobs += [(int(i), b"", p.tobytes()) for i, p in enumerate(np.array_split(pairs, min(buckets, 1 + len(pairs) // 256))) if len(p)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blobs], pa.int32()), pa.array([x[1] for x in blobs], pa.binary()), pa.array([x[2] for x in blobs], pa.binary())], ["bucket", "sig", "node"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for _, rows, h, size, key in set_rows(batch.column(0), n):
                row, sig = signer(rows, h, size)
                mine = sig % np.uint64(turns) == turn
                held.append((sig[mine] // np.uint64(turns), key[row[mine]]))
                count += len(held[-1][0])
                if count >= HELD:
                    yield from rows_of(*map(np.concatenate, zip(*held)))
                    held, count = [], 0
        if count:
            yield from rows_of(*map(np.concatenate, zip(*held)))

    return sign


def _meet(table: pa.Table) -> pa.Table:
    sigs, nodes, pairs = [], [], []
    for s, v in zip(table.column("sig").to_pylist(), table.column("node").to_pylist()):
        if s:
            sig, node = unpacked(s, v)
            sigs.append(sig)
            nodes.append(node)
        else:
            pairs.append(np.frombuffer(v, np.uint64).reshape(-1, 2))
    if sigs:
        _, _, a, b = stars(np.concatenate(sigs), np.concatenate(nodes))
        pairs.append(np.stack([a, b], axis=1))
    edges = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def jaccard_join(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and the (small) columns in keep: documents whose sets of n-word shingles have Jaccard >= percent / 100 link.

    Words are lower-cased (A-Z). A text of fewer words is one shingle; null, empty and blank texts have no set and
    link with nothing. component_id is the smallest doc_id that links reach. Equal sets are one node, however
    many documents have them, so copies are never paired; a signature's nodes are joined as a star, in each task
    first, so a common signature costs one row a task. Repeated rows give a row each; an empty table gives none;
    other columns are ignored.
    """
    return signed_join(spark, docs, n, percent, lambda rows, h, size: signatures(rows, h, size, percent), keep, TURNS)


def signed_join(spark: SparkSession, docs: DataFrame, n: int, percent: int, signer: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], keep: tuple[str, ...], turns: int = 1) -> DataFrame:
    """Documents linked by Jaccard among those that share a signature: signer gives (row, signature) for sets given as sorted hashes by row, and their sizes.

    Each of the turns makes all signatures and sends on its share. While candidates are sought a node goes by its short form, which takes fewer bytes; what is compared are whole sets.
    """
    scratch = Scratch(spark)
    narrow_batches(spark)
    keyed = scratch.table(set_keys(docs, n, keep))
    # a bucket has the signatures of so many shingles on average, however much there is
    buckets = -(-max(BUCKETS, 4 * parts(spark), (keyed.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET) // turns)
    signed = [docs.select("text").mapInArrow(_sign(n, signer, buckets, turn, turns), "bucket int, sig binary, node binary") for turn in range(turns)]
    edges = reduce(DataFrame.union, [scratch.table(s.groupBy("bucket").applyInArrow(_meet, "a long, b long")) for s in signed])
    return link_components(spark, docs, keyed, edges, n, percent, scratch, keep)
