"""What the operators share: intermediate tables, exact ranks without hot tasks, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or a local one where that is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def narrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let no more rows than these go to a Python task at once, as whole texts and their sets are held for each: workers, and the buffers of the JVM, then stay small."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= rows:
        spark.conf.set(size, str(rows))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in here lets its shuffle files go at its end. Otherwise they stay until the driver collects its garbage, which a large one
    seldom does, and a collection that is asked for comes too early where Spark still holds the plan. Other plans' shuffles stay."""
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, None)
    spark.conf.set(freed, "true")
    try:
        yield
    finally:
        spark.conf.unset(freed) if before is None else spark.conf.set(freed, before)


class Scratch:
    """Tables written to the shared folder: they cut the lineage, survive lost executors, and go when no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write df once and read it again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with shuffles_freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def bucketed(self, df: DataFrame, n: int, key: str) -> DataFrame:
        """Write df once, in n buckets by key, so that later reads are dealt by key without a shuffle."""
        self.n += 1
        name = f"millrace_{uuid.uuid4().hex}"
        df.write.option("path", f"{self.root}/{self.n}").option("compression", "uncompressed").bucketBy(n, key).saveAsTable(name)
        back = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalogue's entry, not the files
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that no later step reads."""
        for t in tables:
            if path := getattr(t, "scratch_path", None):
                jvm = self.spark._jvm.org.apache.hadoop.fs
                at = jvm.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: list[str], h: str, out: str = "rank", extra: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key from 0 in order of h, a uniform 64-bit hash, however many rows a key has.

    A window over a hot key would sort it in one task. Instead the top ten bits of h split every key into 1024
    ordered slices: slice counts give each slice its offset, and row_number runs within slices only.
    extra: a table with one row a key (columns keys and others) whose columns are to be added on the way.
    Keys must not be null. Rows with equal h are numbered in either order, so h is to be of all that tells rows apart.
    """
    salted = df.withColumn("_salt", F.shiftright(F.col(h), 54))
    slices = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if extra is not None:
        slices = slices.join(extra, keys)
    within = Window.partitionBy(*keys, "_salt").orderBy(h)
    return salted.join(slices, [*keys, "_salt"]).withColumn(out, F.col("_off") + F.row_number().over(within) - 1).drop("_salt", "_off")


#: Edges that one task joins at most: 4 MB.
TASK_EDGES = 1 << 18


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) for every id of the edges: larger roots are hung below smaller ones that an edge leads to until no edge is between two."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[root]


def _rooted(names: tuple[str, str], most: int) -> Callable:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        ids, roots = rooted(a, b)
        keep = np.full(len(ids), True) if names[0] == "id" else ids != roots
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in ((ids, roots) if names[0] == "id" else (roots, ids))], list(names))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                held = [out(held)]
                if held[0].num_rows * 2 > most:
                    yield from held
                    held = []
        if held:
            yield out(held)

    return each


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most: int = TASK_EDGES) -> DataFrame:
    """(id, root) for every id in edges (a, b): root is the smallest id that edges lead to.

    Each task first puts a star for every group that its own edges connect. While there are more edges than one task
    joins (most), rounds over all tasks map every vertex to the smallest of its neighbours and itself and contract the
    edges accordingly; a component's smallest vertex never moves. The edges that are left, a number that doesn't grow
    with the input, are joined at once, and walking the maps back gives the roots. Only how many edges are left comes to the driver.
    """
    stars = lambda df: df.mapInArrow(_rooted(("a", "b"), most), "a long, b long")
    edges = scratch.table(stars(edges.select("a", "b").filter("a != b")))
    maps: list[DataFrame] = []
    while edges.count() > most:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
        step = scratch.table(ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("root")))
        maps.append(step)
        to_a, to_b = step.select(F.col("id").alias("a"), F.col("root").alias("ra")), step.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("ra != rb")
        left = scratch.table(stars(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()))
        scratch.drop(edges)
        edges = left
    found = scratch.table(edges.coalesce(1).mapInArrow(_rooted(("id", "root"), 2 * most), "id long, root long"))
    scratch.drop(edges)
    if not maps:
        return found
    while maps:
        later = found.select(F.col("id").alias("root"), F.col("root").alias("last"))
        found = maps.pop().join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    return scratch.table(found)
