"""Near-duplicate embeddings: PCA-ordered tiled comparison that stops where the cosine can't be reached."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, components

#: Vectors of a tile at most, and tiles that even small tables are cut into where they have vectors enough.
TILE, LEAST_TILES, LEAST_TILE = 4096, 8, 64
#: Leading axes that a tile's box is kept for; share of all variance that the axes accumulated first hold at least.
BOX, FIRST = 8, 0.4
SLACK = 1e-4
MEMBER = "tile long, pos int, id long, n long, embedding array<double>, x int, lo array<double>, hi array<double>, lead binary"


def moments(dim: int) -> Callable:
    """Sums of products of unit vectors, one row for each matrix row and task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], ["i", "j", "s"])

    return add


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one; largest components are made 1 first, so that no square over- or underflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lead(dim: int, axes: np.ndarray) -> Callable:
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = unit(batch.column("embedding"), dim) @ axes[:, :2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y[:, 0]), pa.array(y[:, -1])], ["id", "n", "embedding", "c1", "c2"])

    return lead


def leading(x: np.ndarray, axes: np.ndarray, first: int) -> np.ndarray:
    """Coordinates on the first principal axes and, as one more, the norm of the rest: the product of two such rows bounds the whole product from above."""
    y = x @ axes
    return np.hstack([y[:, :first], np.sqrt((y[:, first:] ** 2).sum(axis=1, keepdims=True))]).astype(np.float32)


def _tile(dim: int, axes: np.ndarray, first: int) -> Callable:
    def build(table: pa.Table) -> pa.Table:
        """The tile's members, numbered, and one row (pos -1) for the tile: its box and its members' leading coordinates."""
        x = unit(table.column("embedding").combine_chunks(), dim)
        y, m = x @ axes[:, :BOX], table.num_rows
        head = {"tile": table.column("tile")[0].as_py(), "pos": -1, "x": table.column("x")[0].as_py(), "lo": y.min(axis=0).tolist(), "hi": y.max(axis=0).tolist(), "lead": leading(x, axes, first).tobytes()}
        kinds = dict(f.split(" ") for f in MEMBER.split(", "))
        schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}[k]) for c, k in kinds.items()])
        rows = {"tile": table.column("tile"), "pos": pa.array(np.arange(m), pa.int32()), "id": table.column("id"), "n": table.column("n"), "embedding": table.column("embedding").combine_chunks().cast(pa.list_(pa.float64())), "x": table.column("x")}
        members = pa.table([rows[c] if c in rows else pa.nulls(m, schema.field(c).type) for c in kinds], schema=schema)
        return pa.concat_tables([pa.Table.from_pylist([head], schema=schema), members])

    return build


def _survivors(first: int, threshold: float) -> Callable:
    def survive(table: pa.Table) -> pa.Table:
        """Members of two tiles that may have a link to the other tile, by the bound that the leading axes and the norms of the rest give."""
        tile, other = (table.column(c)[0].as_py() for c in ("tile", "other"))
        side = table.column("side").to_numpy()
        leads = [np.frombuffer(table.column("lead")[int(np.flatnonzero(side == s)[0])].as_py(), np.float32).reshape(-1, first + 1) for s in ((0, 1) if tile != other else (0, 0))]
        bound = leads[0] @ leads[1].T
        if tile == other:
            np.fill_diagonal(bound, -1)
        open_ = bound >= threshold - SLACK
        found = [(s, np.flatnonzero(open_.any(axis=1 - s))) for s in ((0, 1) if tile != other else (0,))]
        pos = np.concatenate([f for _, f in found])
        own = np.concatenate([np.full(len(f), s) for s, f in found])
        return pa.table({"a": pa.array(np.full(len(pos), tile)), "b": pa.array(np.full(len(pos), other)), "side": pa.array(own, pa.int32()), "tile": pa.array(np.where(own == 0, tile, other)), "pos": pa.array(pos, pa.int32())})

    return survive


def _exact(dim: int, threshold: float) -> Callable:
    def exact(table: pa.Table) -> pa.Table:
        """Links between the survivors of two tiles by whole products: each one's number of links here, and the least id that links here lead to."""
        side, one = table.column("side").to_numpy(), table.column("a")[0] == table.column("b")[0]
        x, ids, many = unit(table.column("embedding").combine_chunks(), dim), table.column("id").to_numpy(), table.column("n").to_numpy()
        p, q = (np.flatnonzero(side == s) for s in ((0, 0) if one else (0, 1)))
        links = x[p] @ x[q].T >= threshold
        if one:
            np.fill_diagonal(links, False)
        left, right = ids[p].copy(), ids[q].copy()
        while True:  # every vector takes the least label that it sees until none changes
            low = np.minimum(left, np.where(links, right[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            low2 = np.minimum(right, np.where(links, low[:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max))
            if (low == left).all() and (low2 == right).all():
                break
            left, right = low, low2
        out = [(ids[p], links @ many[q], left)] + ([] if one else [(ids[q], many[p] @ links, right)])
        found = [np.concatenate(v) for v in zip(*out)]
        some = found[1] > 0
        return pa.table({c: pa.array(v[some], pa.int64()) for c, v in zip(("id", "links", "root"), found)})

    return exact


def similar_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector: links are pairs with cosine >= threshold.

    Null and zero vectors and those with null or non-finite components link with nothing; vectors of different
    lengths don't link. Rows without a vec_id link as others do and are kept; a component of such rows only has no id. Equal vectors are one node with a count, so copies are linked without being paired. Rows
    of equal vec_id count as vectors of their own that share a component. An empty table gives no rows.

    Tiles are cut by quantiles of the first two principal axes. Two tiles meet unless their slabs or their boxes on the
    leading axes are too far apart. First only the leading coordinates travel, those that hold FIRST of the variance,
    each with the norm of what is left, which bound every product from above; then the whole vectors of those members
    that can still reach the threshold, whose products in double precision decide. All links are counted where
    tiles meet, and only counts and spanning edges leave.
    """
    scratch = Scratch(spark)
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(fine, v).alias("embedding"))
    # a vector whose rows all lack an id stands under a hash, above all ids that are in use
    hashed = F.xxhash64("embedding").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    nodes = rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("_id"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.table(nodes.select("embedding", F.coalesce("_id", hashed).alias("id"), "n", F.col("_id").isNotNull().alias("named")))
    found = None
    for dim, count in sorted((r.d, r.c) for r in nodes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()):
        some = _links(spark, nodes.filter(F.size("embedding") == dim).select("id", "n", "embedding"), dim, count, threshold, scratch)
        found = some if found is None else found.union(some)
    if found is None:  # no vector can link
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.table(found)
    roots = components(spark, found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_node = nodes.join(links, "id", "left").join(roots, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"), "id", "named")
    if not nodes.filter("NOT named").isEmpty():  # the smallest id of each component that has any
        least = of_node.groupBy("component_id").agg(F.min(F.when(F.col("named"), F.col("id"))).alias("_least"))
        of_node = of_node.join(least, "component_id").withColumn("component_id", F.col("_least"))
    out = rows.filter("embedding IS NOT NULL").join(of_node, "embedding").select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter("embedding IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(spark: SparkSession, nodes: DataFrame, dim: int, count: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, links, root) rows: parts of each node's weighted links, and edges that span them."""
    square = np.zeros((dim, dim))
    for r in nodes.select("embedding").mapInArrow(moments(dim), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        square[r.i, r.j] = r.s
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    axes, held = vectors[:, ::-1].copy(), np.cumsum(np.maximum(values[::-1], 0)) / max(1e-300, np.maximum(values, 0).sum())
    first = min(dim, max(BOX, int(np.searchsorted(held, FIRST)) + 1))
    tiles = max(-(-count // TILE), min(LEAST_TILES, -(-count // LEAST_TILE)))
    wide = max(1, round(tiles**0.5))
    high = -(-tiles // wide)
    led = nodes.mapInArrow(_lead(dim, axes), StructType([*nodes.schema.fields]).add("c1", "double").add("c2", "double"))
    quantiles = lambda c, n: F.percentile_approx(c, [i / n for i in range(1, n)] or [0.5], 10_000)
    cut1 = led.agg(quantiles("c1", wide).alias("q")).first().q if wide > 1 else []
    led = led.withColumn("x", sum((F.when(F.col("c1") >= q, 1).otherwise(0) for q in cut1), F.lit(0)))
    cut2 = led.groupBy("x").agg(quantiles("c2", high).alias("q"), F.count(F.lit(1)).alias("m"))
    cut2 = cut2.select("x", F.when(F.lit(high > 1), F.col("q")).otherwise(F.array().cast("array<double>")).alias("q"), F.ceil(F.col("m") / F.lit(high * TILE)).alias("more"))
    led = led.join(cut2, "x").withColumn("y", F.size(F.filter("q", lambda q: q <= F.col("c2"))))
    key = (F.col("x").cast("long") * high + F.col("y")) * 1_000_000 + F.pmod(F.xxhash64("id"), F.col("more"))
    members = scratch.table(led.withColumn("tile", key).select("tile", "x", "id", "n", "embedding").groupBy("tile").applyInArrow(_tile(dim, axes, first), MEMBER))
    heads = members.filter("pos = -1")
    # a slab meets itself and those after it that begin within reach of the tile's end on the first axis
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    last = F.size(F.filter(F.array(*map(F.lit, cut1)).cast("array<double>"), lambda q: q <= F.col("hi")[0] + reach))
    boxes = heads.select("tile", "x", "lo", "hi").withColumn("to", F.explode(F.sequence("x", F.greatest("x", last))))
    others = heads.select(F.col("tile").alias("other"), F.col("x").alias("to"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = lambda i: F.greatest(F.lit(0.0), F.get("lo", i) - F.get("hi2", i), F.get("lo2", i) - F.get("hi", i))
    apart = F.aggregate(F.sequence(F.lit(0), F.size("lo") - 1), F.lit(0.0), lambda s, i: s + gap(i) * gap(i))
    meet = boxes.join(others, "to").filter((F.col("to") > F.col("x")) | (F.col("other") >= F.col("tile"))).filter(apart <= 2 - 2 * threshold + SLACK).select("tile", "other")
    ends = F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("own")) for i, c in enumerate(("tile", "other"))))
    dealt = meet.select("tile", "other", F.explode(F.when(F.col("tile") == F.col("other"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select("tile", "other", "e.*")
    sent = dealt.join(heads.select(F.col("tile").alias("own"), "lead"), "own").select("tile", "other", "side", "lead")
    left = scratch.table(sent.groupBy("tile", "other").applyInArrow(_survivors(first, threshold), "a long, b long, side int, tile long, pos int"))
    whole = left.join(members.filter("pos >= 0").select("tile", "pos", "id", "n", "embedding"), ["tile", "pos"]).select("a", "b", "side", "id", "n", "embedding")
    return whole.groupBy("a", "b").applyInArrow(_exact(dim, threshold), "id long, links long, root long")
