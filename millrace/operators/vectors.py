"""An inverted-file index of vectors: cells fitted on a sample, vectors stored by cell, many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Vectors, and queries, of one block: a block of either side meets in one group.
VECTORS, QUERIES = 4096, 1024
#: Numbers of a table of rows by cells, of which a task holds a few: 2 MB each.
PRODUCTS = 1 << 18
#: Scores are compared by so many decimals, so that equal vectors tie wherever they lie.
DECIMALS = 9
#: What rounding may add to an angle.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Vectors that have a direction: not null, empty or zero, without null or non-finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def units(column: pa.Array) -> np.ndarray:
    """Rows of length one, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.maximum(1e-300, np.abs(x).max(axis=1, keepdims=True))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> np.ndarray:
    """Directions of at most `cells` cells: spherical k-means on about `sample` vectors of the commonest length, chosen by a hash of their key."""
    rows = vectors.filter(usable(F.col(vector))).withColumn("_dim", F.size(vector))
    common = rows.groupBy("_dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_dim").first()
    if common is None:
        return np.zeros((0, 0))
    rows, n = rows.filter(F.col("_dim") == common["_dim"]), common["n"]
    unit = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) / 1_000_003
    got = rows.filter(unit < min(1.0, sample / max(1, n))).select(key, vector).orderBy(key).toArrow()
    if not got.num_rows:
        return np.zeros((0, 0))
    x = units(got.column(vector))
    rng = np.random.default_rng(seed)
    at = x[np.sort(rng.permutation(len(x))[: min(cells, len(x))])]
    for _ in range(rounds):
        own = (x @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), at)
    return at


@dataclass
class Index:
    """Where the vectors lie, their cells' directions, and the names of a vector's key and components."""

    path: str
    cells: np.ndarray
    key: str = "vec_id"
    vector: str = "embedding"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def sliced(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a table of a slice's rows by all cells has no more than PRODUCTS numbers, however many cells there are."""
    rows = max(1, PRODUCTS // max(1, cells))
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _placed(cells: np.ndarray, vector: str) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(cells)):
            product = units(batch.column(vector)) @ cells.T
            own = product.argmax(axis=1)
            angle = np.arccos(np.clip(product[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "_cell", "_angle"])

    return place


def add_vectors(vectors: DataFrame, index: Index, mode: str = "append") -> None:
    """Store vectors (all columns) in order of cell, so that a search reads the row groups of the cells it looks in; large cells spread over files.

    Vectors without a direction, and those of another length than the cells', are not stored: they are like nothing.
    """
    if not index.cells.size:
        return
    fine = vectors.filter(usable(F.col(index.vector)) & (F.size(index.vector) == index.cells.shape[1]))
    placed = fine.mapInArrow(_placed(index.cells, index.vector), StructType([*fine.schema.fields]).add("_cell", "integer").add("_angle", "double"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "_cell", index.key).sortWithinPartitions("_cell", index.key).write.mode(mode).parquet(f"{index.path}/vectors")


def build_index(vectors: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", most: int = 4096, **fit: int) -> Index:
    """Fit cells (by default as many as the root of the number of vectors, `most` at most, which all tasks hold) and store all vectors by cell."""
    cells = cells or max(1, min(most, round(vectors.count() ** 0.5)))
    index = Index(path, fitted_cells(vectors, cells, key=key, vector=vector, **fit), key, vector)
    add_vectors(vectors, index, "overwrite")
    return index


def _probed(cells: np.ndarray, probes: int) -> Callable:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the cells it looks in first."""
        for batch in sliced(batches, len(cells)):
            product = units(batch.column(1)) @ cells.T
            near = np.argsort(-product, axis=1, kind="stable")[:, : min(probes, len(cells))]
            rows = np.repeat(np.arange(len(near)), near.shape[1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:2]), pa.array(near.ravel().astype(np.int32))], ["_query", "_v", "_cell"])

    return probe


def _others(cells: np.ndarray, probes: int, radius: np.ndarray) -> Callable:
    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the cells left that may hold a vector at least as near as its k-th: within the cell's radius of that angle."""
        for batch in sliced(batches, len(cells)):
            product = units(batch.column(1)) @ cells.T
            near = np.argsort(-product, axis=1, kind="stable")[:, : min(probes, len(cells))]
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            within = np.arccos(np.clip(np.where(np.isnan(least), -1, least), -1, 1))[:, None]
            open_ = (np.arccos(np.clip(product, -1, 1)) - radius[None, :] <= within + SLACK) & (radius[None, :] >= 0)
            np.put_along_axis(open_, near, False, axis=1)
            rows, cell = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:2]), pa.array(cell.astype(np.int32))], ["_query", "_v", "_cell"])

    return others


def _best(k: int, key: pa.DataType, query: pa.DataType) -> Callable:
    def best(table: pa.Table) -> pa.Table:
        """The k best of a block of vectors for each query of a block; ties by key."""
        asks = table.column("_asks").to_numpy(zero_copy_only=False)
        q, v = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not q.num_rows or not v.num_rows:
            return pa.table({"_query": pa.array([], query), "_key": pa.array([], key), "score": pa.array([], pa.float64())})
        v = v.sort_by("_key")
        score = np.round(units(q.column("_v")) @ units(v.column("_v")).T, DECIMALS)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(top)), top.shape[1])
        return pa.table({"_query": q.column("_query").take(pa.array(rows)), "_key": v.column("_key").take(pa.array(top.ravel())), "score": pa.array(np.take_along_axis(score, top, axis=1).ravel())})

    return best


def _met(asks: DataFrame, stored: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(_query, _key, score): the best of each block. A cell's vectors and queries are cut into blocks of bounded size, and each block of one side meets each of the other."""
    held = asks.groupBy("_cell").agg(F.count(F.lit(1)).alias("_asked"))
    # a row a cell, of which there are as many as all tasks hold anyway
    cells = F.broadcast(sizes.join(held, "_cell").select("_cell", F.ceil(F.col("_n") / VECTORS).cast("int").alias("_i"), F.ceil(F.col("_asked") / QUERIES).cast("int").alias("_j")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    cell = F.concat_ws(":", "_cell", "_a", "_b").alias("_block")
    one = stored.join(cells, "_cell").withColumn("_a", place("_key", "_i")).withColumn("_b", each("_j")).select(cell, F.lit(False).alias("_asks"), "_key", F.lit(None).cast(asks.schema["_query"].dataType).alias("_query"), "_v")
    two = asks.join(cells, "_cell").withColumn("_b", place("_query", "_j")).withColumn("_a", each("_i")).select(cell, F.lit(True), F.lit(None).cast(stored.schema["_key"].dataType), "_query", "_v")
    key, query = (pa.int64() if t == "bigint" else pa.string() for t in (stored.schema["_key"].dataType.simpleString(), asks.schema["_query"].dataType.simpleString()))
    fields = f"_query {asks.schema['_query'].dataType.simpleString()}, _key {stored.schema['_key'].dataType.simpleString()}, score double"
    return one.union(two).groupBy("_block").applyInArrow(_best(k, key, query), fields)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, where: Column | None = None, exact: bool = False, key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, place, the index's key, score): each query's k stored vectors of largest cosine, ties by key, among those that `where` is true of.

    Keys are longs or strings. A query looks in its `probes` nearest cells; exact: then in all others that may hold
    a nearer vector than its k-th, by the angle of a cell's farthest vector. Queries without a direction find nothing.
    """
    spark = queries.sparkSession
    v = lambda c: F.col(c).cast("array<double>").alias("_v")
    dim = index.cells.shape[1]
    asked = queries.filter(usable(F.col(vector)) & (F.size(vector) == dim)).select(F.col(key).alias("_query"), v(vector))
    rows = index.rows(spark) if where is None else index.rows(spark).filter(where)
    stored = rows.select("_cell", F.col(index.key).alias("_key"), v(index.vector))
    sizes = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_angle").alias("_radius"))
    kind = asked.schema["_query"].dataType.simpleString()
    fields = f"_query {kind}, _v array<double>, _cell int"
    asks = asked.mapInArrow(_probed(index.cells, probes), fields)
    order = Window.partitionBy("_query").orderBy(F.desc("score"), "_key")
    best = lambda df: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    found = best(_met(asks, stored, sizes, k))
    if exact:
        found = found.checkpoint()
        radius = np.full(len(index.cells), -1.0)
        for r in sizes.collect():  # a row a cell
            radius[r["_cell"]] = r["_radius"]
        least = found.groupBy("_query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_least"))
        more = asked.join(least, "_query", "left").select("_query", "_v", "_least").mapInArrow(_others(index.cells, probes, radius), fields)
        found = best(found.drop("place").union(_met(more, stored, sizes, k)))
    return found.select(F.col("_query").alias(key), "place", F.col("_key").alias(index.key), "score")


def probes_for(spark: SparkSession, index: Index, k: int = 10, recall: float = 0.95, queries: int = 200, seed: int = 7) -> int:
    """How many cells a query has to look in to find that share of its k nearest: measured on about `queries` stored vectors, whose true neighbours are searched for exactly."""
    rows = index.rows(spark)
    n = rows.count()
    unit = F.pmod(F.xxhash64(F.lit(seed), index.key), F.lit(1_000_003)) / 1_000_003
    asked = rows.filter(unit < min(1.0, queries / max(1, n))).select(F.col(index.key).alias("query_id"), index.vector)
    true = search(index, asked, k, exact=True, vector=index.vector)
    met = true.join(rows.select(index.key, "_cell"), index.key).join(asked, "query_id").select("query_id", index.vector, "_cell").toArrow()
    if not met.num_rows:
        return 1
    order = np.argsort(np.argsort(-(units(met.column(index.vector)) @ index.cells.T), axis=1, kind="stable"), axis=1)
    place = np.sort(order[np.arange(met.num_rows), met.column("_cell").to_numpy()])
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1
