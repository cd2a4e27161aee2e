"""Prefix tries of conversations: partial node tables merged by hash keys, subtree sums rolled up along chains of owned nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parts

#: A conversation takes fewer than so many first turns from another, one of MATES conversations in a row.
HEAD, MATES = 9, 5
#: Turns of a conversation that one task numbers or sums in order.
CHUNK = 4096
#: A node with more than FEW children and one of FAIR * (shuffle partitions) equal parts of all is sent to those who look for it.
FAIR, FEW = 4, 1000
NODE = ["depth", "x1", "x2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn: the task, and each row's place among its conversation's rows there."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        first = np.flatnonzero(np.diff(conv, prepend=~conv[0]))
        at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
        at[: first[1] if len(first) > 1 else len(conv)] += seen if conv[0] == last else 0
        last, seen = conv[-1], at[-1]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), batch.column("turn_key"), batch.column("bytes")], ["conv_id", "part", "at", "turn_key", "bytes"])


def rebuilt(spark: SparkSession, conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, ends, bytes, turn_key) of every turn of the rebuilt conversations, and (conv_id, ends) of these, ends being how many turns they have.

    Turns are numbered by a sort over all tasks, however many of them a conversation has: a task numbers what it
    holds, and counts of the conversations that several tasks share, one row a task and conversation, are added.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "turn_key", "_id"]
    turns = turns.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    turns = scratch.table(turns.select("conv_id", "turn_key", "bytes").mapInArrow(_numbered, "conv_id long, part int, at long, turn_key binary, bytes long"))
    runs = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    runs = scratch.table(runs.select("conv_id", "part", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total")))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = runs.groupBy("conv_id").agg(F.max("total").alias("total")).withColumn("base", F.col("conv_id") - F.col("conv_id") % MATES)
    bases = runs.filter(F.col("conv_id") % MATES == 0).groupBy(F.col("conv_id").alias("base")).agg(F.max("total").alias("_most"))
    convs = convs.join(bases, "base", "left").withColumn("head", heads).withColumn("taken", F.least("head", F.coalesce("_most", F.lit(0))))
    convs = scratch.table(convs.withColumn("ends", F.col("taken") + F.greatest(F.lit(0), F.col("total") - F.col("head"))).select("conv_id", "base", "head", "taken", "ends"))
    placed = turns.join(runs.select("conv_id", "part", "before").join(convs.drop("base"), "conv_id"), ["conv_id", "part"])
    placed = scratch.table(placed.select("conv_id", (F.col("before") + F.col("at")).alias("at"), "head", "taken", "ends", "bytes", "turn_key"))
    first = placed.filter(F.col("at") < HEAD).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "bytes", "turn_key")
    first = first.join(convs.filter("taken > 0").select("base", "conv_id", "taken", "ends"), "base").filter("depth <= taken")
    rest = placed.filter(F.col("at") > F.col("head")).withColumn("depth", F.col("taken") + F.col("at") - F.col("head"))
    names = ["conv_id", "depth", "ends", "bytes", "turn_key"]
    return first.select(names).union(rest.select(names)), convs.select("conv_id", "ends")


def chunk() -> Column:
    return F.expr(f"(depth - 1) div {CHUNK}").alias("chunk")


def paths(spark: SparkSession, turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, ends, bytes, x1, x2, p1, p2): the node of every first part of a conversation, the empty one too, and that node's parent.

    A node's key is the exclusive or of hashes of its turns and their places, twice 64 bits, so that long conversations are keyed in chunks.
    """
    turns = turns.select("conv_id", "depth", "ends", "bytes", chunk(), *(F.xxhash64(F.lit(s), "depth", "turn_key").alias(f"y{s}") for s in (1, 2)))
    turns = scratch.table(turns)
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.filter(F.col("ends") > CHUNK).groupBy("conv_id", "chunk").agg(*(F.bit_xor(f"y{s}").alias(f"y{s}") for s in (1, 2)))
    sums = sums.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(f"y{s}").over(earlier), F.lit(0)).alias(f"_b{s}") for s in (1, 2)))
    keyed = turns.withColumns({f"x{s}": F.bit_xor(f"y{s}").over(within) for s in (1, 2)}).join(sums, ["conv_id", "chunk"], "left")
    keyed = keyed.withColumns({f"x{s}": F.col(f"x{s}").bitwiseXOR(F.coalesce(f"_b{s}", F.lit(0))) for s in (1, 2)})
    keyed = keyed.select("conv_id", "depth", "ends", "bytes", "x1", "x2", *(F.col(f"x{s}").bitwiseXOR(F.col(f"y{s}")).alias(f"p{s}") for s in (1, 2)))
    none = F.lit(0).cast("long")
    return scratch.table(keyed.union(convs.select("conv_id", none, "ends", none, none, none, none, none)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and conv_id: each node's ids of a batch as one text."""
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in NODE]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        ids = pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows).astype(np.int32)), batch.column("conv_id").cast(pa.string()))
        yield pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in keys), batch.column("conv_id").take(pa.array(first)), pc.binary_join(ids, ",")], [*NODE, "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and first id: the digest of each node's texts, read one after another."""
    node, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column("ids")):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.as_buffer())
        yield _digests(done)
    yield _digests([(*node, digest.hexdigest())] if node is not None else [])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])


def end_digests(spark: SparkSession, path: DataFrame) -> DataFrame:
    """ends_sha256 of every node that conversations end at. Ids are sorted over all tasks and joined to texts there; a node's digest reads these texts only."""
    order = [*NODE, "conv_id"]
    ends = path.filter("depth = ends").select(order).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    texts = ends.mapInArrow(_joined, "depth long, x1 long, x2 long, first long, ids string")
    texts = texts.repartition(parts(spark), *NODE).sortWithinPartitions(*NODE, "first")
    return texts.mapInArrow(_digested, "depth long, x1 long, x2 long, ends_sha256 string")


def conversation_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A node belongs to its smallest member. What a conversation owns of its path are its last nodes, so sums over a
    subtree are sums over the members: each adds all it owns, and the owner's part above the node is taken off. Every
    task makes the partial trie of its rows, and these are merged by the nodes' keys; no step follows the depth of the trie.
    Turns of equal number go by a digest of role and text. Null roles and texts are empty, a null turn comes first,
    rows without a conv_id belong to no conversation, repeated rows are turns of their own, and texts of any length
    are digested whole. Only conv_id, turn, role and text are read, so other columns may have any name. An empty table has no nodes.
    """
    scratch = Scratch(spark)
    turns, convs = rebuilt(spark, conversations, scratch)
    path = paths(spark, turns, convs, scratch)
    merged = path.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("_bytes"), F.count_if(F.col("depth") == F.col("ends")).alias("_ends"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    saves = ((F.col("n_convs") - 1) * F.col("_bytes")).alias("saves")
    nodes = scratch.table(merged.select(*NODE, "p1", "p2", "conv_id", "n_convs", saves, (F.col("_ends") == F.col("n_convs")).alias("is_leaf"), chunk()))
    # what each conversation owns, and what of it lies above each node
    owned = nodes.groupBy("conv_id").agg(F.sum("saves").alias("all"), F.min("depth").alias("from"), F.max("depth").alias("ends"), F.max_by("is_leaf", "depth").cast("long").alias("leaf"))
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.groupBy("conv_id", "chunk").agg(F.sum("saves").alias("_s")).withColumn("_earlier", F.sum("_s").over(earlier)).filter("_earlier IS NOT NULL").drop("_s")
    chain = nodes.withColumns({"_above": F.sum("saves").over(within.rowsBetween(Window.unboundedPreceding, -1)), "_own": F.lag("depth").over(within).isNotNull()}).join(sums, ["conv_id", "chunk"], "left")
    chain = chain.select(*NODE, "p1", "p2", "conv_id", "n_convs", (F.coalesce("_above", F.lit(0)) + F.coalesce("_earlier", F.lit(0))).alias("above"), (F.col("_own") | F.col("_earlier").isNotNull()).alias("under_own"))
    # sums over the members of each node
    owned = owned.select("conv_id", "all", "from", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ends - 1) div {CHUNK}"))).alias("chunk"))
    adds = path.select("conv_id", "ends", *NODE, chunk()).join(owned, ["conv_id", "chunk"])
    child = (F.col("from") <= F.col("depth") + 1) & (F.col("depth") < F.col("ends"))
    over = adds.groupBy(*NODE).agg(F.sum("all").alias("all"), F.sum("leaf").alias("n_leaves"), F.count_if(child).alias("n_children"))
    whole = chain.join(over, NODE).join(end_digests(spark, path), NODE, "left")
    whole = scratch.table(whole.select(*NODE, "p1", "p2", "conv_id", "under_own", "n_convs", "n_children", "n_leaves", (F.col("all") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    # parents that are not the node's own conversation's: those of very many children, of which there can only be FAIR * partitions, go to all tasks
    named = whole.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("_parent"), "n_children")
    fair = max(FEW, whole.count() // (FAIR * parts(spark)))
    many, few = F.broadcast(named.filter(F.col("n_children") > fair).drop("n_children")), named.filter(F.col("n_children") <= fair).drop("n_children")
    up = ["depth", "p1", "p2"]
    strangers = whole.filter("NOT under_own AND depth > 0")
    found = strangers.join(many, up).unionByName(strangers.join(many, up, "left_anti").join(few, up))
    rest = whole.filter("under_own OR depth = 0").withColumn("_parent", F.when(F.col("depth") > 0, F.col("conv_id")))
    return rest.unionByName(found).select("conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
