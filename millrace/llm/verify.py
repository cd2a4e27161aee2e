"""Exact Jaccard links inside clusters of candidate documents, in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, parts
from .tokens import distinct, mix, shingles, slices, words

#: Sets of a block that meets its group's pivots, and of a block that meets a block of what the pivots left over.
BLOCK, REST = 256, 1024
#: Members of candidate clusters that are sent to all tasks at most: 24 MB.
SENT = 1_000_000
#: The bits of a node by which it goes in candidate edges.
SHORT = (1 << 40) - 1
#: Pivots of a group, on average; groups of no more sets consist of pivots only.
PIVOTS = 32
#: A group of more nodes than one of FAIR * (shuffle partitions) equal parts of all is split where it meets its count.
FAIR = 4
#: Cells of the sketch that bounds from below how many elements two sets don't share.
CELLS = 256
#: Bits of the smaller sketch that travels without the set: each is the parity of the elements it stands for.
BITS = 1024


def bands(percent: int, largest: int) -> np.ndarray:
    """First sizes of the size bands: a set's partners lie in its own band or the next, as sizes differ by 100 / percent at most."""
    lo = [1]
    while lo[-1] <= largest:
        lo.append(max(lo[-1], 100 * lo[-1] // percent) + 1)
    lo.append(max(lo[-1], 100 * lo[-1] // percent) + 1)
    return np.array(lo)


def set_rows(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, sorted distinct shingle hashes, set sizes, set keys) of a slice of texts; the key of an empty set is 0."""
    for lo, hi, off, data in slices(texts):
        _, _, rows, h = words(off, data)
        rows, h = distinct(*shingles(rows, h, n))
        size = np.bincount(rows, minlength=hi - lo)
        key = np.zeros(hi - lo, dtype=np.uint64)
        if len(h):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            key[rows[first]] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first))
        yield lo, rows, h, size, key


def _keys(n: int, keep: tuple[str, ...]) -> Callable:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(s, k) for _, _, _, s, k in set_rows(batch.column("text"), n)]
            size = np.concatenate([s for s, _ in got]) if got else np.zeros(0, np.int64)
            key = np.concatenate([k for _, k in got]) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(key.view(np.int64)), *(batch.column(c) for c in keep)], ["doc_id", "n_shingles", "node", *keep])

    return keys


def set_keys(docs: DataFrame, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, node (a 64-bit key of the document's shingle set, equal for equal sets), and the columns in keep."""
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(_keys(n, keep), f"doc_id long, n_shingles long, node long{kept}")


def _wanted(n: int, percent: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("node").to_numpy().view(np.uint64)
            for lo, rows, h, size, key in set_rows(batch.column("text"), n):
                keep, blobs, band, size_of, odd = [], [], [], [], []
                upto = np.concatenate([[0], np.cumsum(size)])
                own = np.searchsorted(bands(percent, int(size.max())), size, "right") - 1
                for i in np.flatnonzero(key == want[lo : lo + len(key)]):
                    keep.append(lo + i)
                    part = h[upto[i] : upto[i + 1]]
                    blobs.append(part.tobytes())
                    odd.append(np.packbits(np.bincount((mix(part) >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).tobytes())
                    band.append(own[i])
                    size_of.append(size[i])
                cols = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("cluster", "node")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(band, pa.int32()), pa.array(size_of, pa.int64()), pa.array(odd, pa.binary()), pa.array(blobs, pa.binary())], ["cluster", "node", "band", "n", "odd", "hashes"])

    return sets


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(h: np.ndarray) -> np.ndarray:
    out = np.zeros(CELLS, dtype=np.uint64)
    cell = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out[cell[first]] = np.add.reduceat(mix(h), first)
    return (out >> np.uint64(48)).astype(np.uint16)


#: Says which of the rest rows of a table may link (or link) to row i.
Linker = Callable[[int, np.ndarray], np.ndarray]


def _by_parity(percent: int) -> Callable[[pa.Table, np.ndarray], Linker]:
    def make(table: pa.Table, rows: np.ndarray) -> Linker:
        """Sets that their parities don't tell apart: an element that only one of two sets has flips one bit, so as many bits as differ, elements differ at least.

        Sets that are here as smaller partners only (step 1) are not compared with each other: their own band does that.
        """
        n, step = (table.column(c).to_numpy()[rows].astype(np.int64) for c in ("n", "step"))
        blobs = table.column("odd").combine_chunks()
        odd = np.frombuffer(b"".join(blobs[int(i)].as_py() for i in rows), np.uint64).reshape(len(rows), -1)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[(step[rest] + step[i] < 2) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            differ = np.bitwise_count(odd[rest] ^ odd[i]).sum(axis=1, dtype=np.int64)
            return rest[differ * (100 + percent) <= (n[rest] + n[i]) * (100 - percent)]

        return near

    return make


def _by_sets(percent: int) -> Callable[[pa.Table, np.ndarray], Linker]:
    def make(table: pa.Table, rows: np.ndarray) -> Linker:
        """Sets that link: first by a sketch, of which every cell that differs holds at least one element that only one of the two has, then exactly."""
        blobs = table.column("hashes").combine_chunks()
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), dtype=np.uint64) for i in rows]
        n = np.array([len(s) for s in sets])
        sketch = np.stack([_sketch(s) for s in sets])

        def link(i: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
            differ = (sketch[rest] != sketch[i]).sum(axis=1)
            rest = rest[differ * (100 + percent) <= (n[rest] + n[i]) * (100 - percent)]
            return rest[np.array([linked(sets[i], sets[j], percent) for j in rest], dtype=bool)]

        return link

    return make


class Joined:
    """Groups of connected nodes, and the edges that connected them."""

    def __init__(self, label: np.ndarray):
        self.label, self.edges = label, []

    def meet(self, link: Linker, i: int, rest: np.ndarray) -> None:
        """Join i with those of the rest that it links to; what is joined already is not compared."""
        for j in link(i, rest[self.label[rest] != self.label[i]]):
            if self.label[i] != self.label[j]:
                self.edges.append((i, j))
                self.label[self.label == self.label[j]] = self.label[i]


def _pivoted(make: Callable[[pa.Table, np.ndarray], Linker], keys: list[str], schema: pa.Schema) -> Callable:
    def pivoted(table: pa.Table) -> pa.Table:
        """Edges of a block's members to the group's pivots, and (b null) those members that are not joined to the core: the largest set of pivots joined among themselves, which is the same in every block."""
        node, rows = np.unique(table.column("node").to_numpy(), return_index=True)
        pivot, own = (table.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("pivot", "own"))
        link, group = make(table, rows), Joined(np.arange(len(node)))
        pivots, members = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        for k, i in enumerate(pivots):
            group.meet(link, i, pivots[k + 1 :])
        labels, many = np.unique(group.label[pivots], return_counts=True)
        core = pivots[np.argmax(group.label[pivots] == labels[np.argmax(many)])] if len(pivots) else None
        for i in pivots:
            group.meet(link, i, members)
        rest = np.flatnonzero(own & (group.label != group.label[core])) if core is not None else np.flatnonzero(own)
        rest = rest if table.column("wide")[0].as_py() else rest[:0]  # among the pivots all pairs have been compared
        a = np.concatenate([np.array([i for i, _ in group.edges], dtype=np.int64), rest])
        b = np.array([node[j] for _, j in group.edges] + [0] * len(rest), dtype=np.int64)
        cols = {k: pa.array(np.full(len(a), table.column(k)[0].as_py())).cast(schema.field(k).type) for k in keys}
        return pa.table(cols | {"a": pa.array(node[a]), "b": pa.array(b, mask=np.arange(len(a)) >= len(group.edges))})

    return pivoted


def _rest(make: Callable[[pa.Table, np.ndarray], Linker]) -> Callable:
    def rest(table: pa.Table) -> pa.Table:
        """Edges between a block of what the pivots left over and a block of the group; members of the core are joined to each other already."""
        node, over = table.column("node").to_numpy(), table.column("over").to_numpy(zero_copy_only=False)
        # a set that is here for both sides is there once, as one that was left over
        order = np.lexsort((~over, node))
        node, rows = np.unique(node[order], return_index=True)
        rows = order[rows]
        left_over, core = over[rows], ~table.column("left_over").to_numpy(zero_copy_only=False)[rows]
        link, group = make(table, rows), Joined(np.where(core, -1, np.arange(len(node))))
        every = np.arange(len(node))
        for i in np.flatnonzero(left_over):
            group.meet(link, i, every[every != i])
        return pa.table({"a": pa.array([int(node[i]) for i, _ in group.edges], pa.int64()), "b": pa.array([int(node[j]) for _, j in group.edges], pa.int64())})

    return rest


def spanning(rows: DataFrame, keys: list[str], carried: list[str], make: Callable[[pa.Table, np.ndarray], Linker], scratch: Scratch) -> DataFrame:
    """Edges (a, b) that span the links between the nodes of each group, without comparing all pairs of a group of copies.

    About PIVOTS nodes of a group, chosen by hash, are sent to all blocks of it. What links to the pivots is joined
    to them there; most of a group of copies then is one core. Only what is left over meets all nodes of its group,
    in blocks; in groups of no more than PIVOTS nodes nothing is.
    """
    counts = scratch.table(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1"))
    # groups that hold more than a task's fair share meet their counts in several tasks; no more than FAIR * parts groups can
    total = counts.agg(F.sum("_m")).first()[0] or 0
    fair = max(BLOCK, total // (FAIR * parts(rows.sparkSession)))
    tasks = F.ceil(F.col("_m") / fair).cast("int")
    large = F.broadcast(counts.filter(F.col("_m") > fair).select(*keys, tasks.alias("_tasks")))
    salted = [*keys, "_salt"]
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    sized = rows.join(large, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), "node"), F.coalesce("_tasks", F.lit(1))).cast("int")).drop("_tasks").join(counts, salted)
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit(7), "node"), F.greatest("_m", F.lit(PIVOTS))) < PIVOTS
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = sized.withColumn("pivot", pivot).withColumn("mine", mine).withColumn("block", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("mine"))))
    # one column names the block: rows dealt by the group's keys, as a join leaves them, would count as dealt by group and block
    cell = lambda *names: F.concat_ws(":", *(F.col(c).cast("string") for c in (*keys, *names))).alias("cell")
    dealt = dealt.select(cell("block"), *keys, "node", "pivot", (F.col("_m") > PIVOTS).alias("wide"), (F.col("block") == F.col("mine")).alias("own"), *carried)
    out = rows.select(*keys).schema
    edges_of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out)
    arrow = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32()) for f in out])
    first = scratch.table(dealt.groupBy("cell").applyInArrow(_pivoted(make, keys, arrow), f"{edges_of}, a long, b long"))
    over = first.filter("b IS NULL").select(*keys, F.col("a").alias("node")).distinct()
    if over.isEmpty():
        return first.select("a", "b")
    many = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("_o")).join(counts.select(*salted), keys)
    left = sized.join(many, salted).join(over.withColumn("left_over", F.lit(True)), [*keys, "node"], "left").withColumn("left_over", F.coalesce("left_over", F.lit(False)))
    place = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / REST)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / REST).cast("int") - 1))
    names = [cell("i", "j"), "node", "over", "left_over", *carried]
    one = left.withColumns({"over": F.lit(False), "j": place("_m")}).withColumn("i", every("_o")).select(*names)
    two = left.filter("left_over").withColumns({"over": F.lit(True), "i": place("_o")}).withColumn("j", every("_m")).select(*names)
    second = scratch.table(one.union(two).groupBy("cell").applyInArrow(_rest(make), "a long, b long"))
    return first.filter("b IS NOT NULL").select("a", "b").union(second)


def nameless_texts(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(text, node, cluster) of wanted nodes (node, cluster) all of whose documents lack a doc_id, found by a hash of their texts; copies are put together in each task first."""
    texts = docs.filter("doc_id IS NULL").select("doc_id", "text", F.xxhash64("text").alias("_of"))
    of = set_keys(texts, n, ("_of",)).groupBy("node").agg(F.min("_of").alias("_of"))
    return texts.groupBy("_of").agg(F.min("text").alias("text")).join(of.join(wanted, "node"), "_of").select("text", "node", "cluster")


def clusters_of(spark: SparkSession, nodes: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of the nodes that candidate edges between short forms lead to others from; nodes of one short form are candidates of each other."""
    short = nodes.select(F.col("node").alias("id"), F.col("node").bitwiseAND(F.lit(SHORT)).alias("_short"))
    alike = short.groupBy("_short").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_short").alias("id"), F.col("_short").alias("root"))
    roots = components(spark, candidates, scratch)
    roots = roots.union(alike.join(roots, "id", "left_anti")).withColumnRenamed("id", "_short")
    return scratch.table(short.join(roots, "_short").select("id", "root"))


def link_components(spark: SparkSession, docs: DataFrame, keyed: DataFrame, candidates: DataFrame, n: int, percent: int, scratch: Scratch, keep: tuple[str, ...] = ()) -> DataFrame:
    """component_id of every row of keyed (doc_id, n_shingles, node, and what is in keep), from candidate edges (a, b) between nodes in short form.

    Candidate edges only say which sets must be compared: all sets of a connected cluster of them are, within bands
    of size, by 128 bytes of parities, which bound the difference from below. The clusters that are left are compared
    likewise, by a larger sketch and then exactly. Either time only spanning edges are sought (spanning), so edges may
    be left out where their ends stay connected, and a cluster of copies takes work in proportion to its members.
    Sets are rebuilt from the texts of one document for each distinct set. Documents without a doc_id link as others do,
    and others link through them; as they have no id to give, a component of such documents only has none.
    """
    first = scratch.table(keyed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep")))
    clusters = clusters_of(spark, first, candidates, scratch)
    members = clusters.join(first, clusters.id == first.node).select(F.col("rep").alias("doc_id"), "node", F.col("root").alias("cluster"))
    members = scratch.table(members)
    # few documents are members: up to so many, at 24 bytes each, they go to the texts; beyond that both are shuffled
    members = F.broadcast(members) if members.count() <= SENT else members.hint("merge")
    texts = docs.select("doc_id", "text").join(members, "doc_id").select("text", "node", "cluster")
    if not (nameless := clusters.join(first.filter("rep IS NULL"), clusters.id == first.node).select("node", F.col("root").alias("cluster"))).isEmpty():
        texts = texts.union(nameless_texts(docs, n, scratch.table(nameless)))
    sets = scratch.table(texts.mapInArrow(_wanted(n, percent), "cluster long, node long, band int, n long, odd binary, hashes binary"))
    banded = sets.select("cluster", "node", "n", "odd", F.posexplode(F.array("band", F.col("band") + 1)).alias("step", "size_band"))
    near = scratch.table(spanning(banded, ["cluster", "size_band"], ["n", "step", "odd"], _by_parity(percent), scratch))
    closer = components(spark, near, scratch).select(F.col("id").alias("node"), F.col("root").alias("cluster"))
    links = scratch.table(spanning(sets.select("node", "hashes").join(closer, "node"), ["cluster"], ["hashes"], _by_sets(percent), scratch))
    scratch.drop(sets, near)
    groups = components(spark, links, scratch)
    roots = groups.join(first, groups.id == first.node).select("root", "rep", "node")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = roots.join(least, "root").select("node", "component_id")
    alone = first.join(joined, "node", "left_anti").select("node", F.col("rep").alias("component_id"))
    of_node = joined.union(alone).withColumnRenamed("node", "_node")
    key = F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.xxhash64("doc_id"))
    out = keyed.withColumn("_key", key).join(of_node, F.col("_key") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *keep)
