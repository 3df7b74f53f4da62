"""What the corpus operators share: scratch tables, bounded Arrow batches, components.

Scratch tables are Parquet files below the folder in ``spark.checkpoint.dir``,
which the driver and all executors see; writing one cuts the lineage, so a lost
executor costs the tasks it ran and nothing that is already written.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: 256 texts bound a worker's memory even where texts are very long.
BATCH_ROWS = 256
#: Bytes after which a batch ends (the row that passes them is its last).
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local master gets a temporary folder (as in
    tests); any other master raises, since a machine-local folder would be wrong.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="framelake-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{local}")
    return f"file://{local}"


_CLEANED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder, which is deleted when the driver's Python ends."""
    own = f"{shared_dir(spark)}/framelake-{spark.sparkContext.applicationId}"
    if own not in _CLEANED:
        _CLEANED.add(own)
        atexit.register(_clean, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def _clean(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Table:
    """A DataFrame written to the shared folder; ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        # Spark removes the shuffle files of finished jobs only when the driver collects garbage.
        self.spark._jvm.System.gc()

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


#: Rows of a small table that is broadcast at most (tens of MB).
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A small side of a join, written and counted: broadcast if it is small indeed.

    Beyond that it is read from its files, so that the join's sides are plain
    shuffles, of which adaptive execution can split the skewed partitions.
    """
    written = Table(df, name).df
    return F.broadcast(written) if written.count() <= rows else written


#: A key is hot if it has more than one in so many rows; so there are no more hot keys than this.
HOT_SHARE = 2000


def hot_join(df: DataFrame, keys: DataFrame, on: list[str], count: str) -> DataFrame:
    """df joined with a table of distinct keys that says how many of df's rows each has.

    Hot keys are at most HOT_SHARE by their definition, so they are broadcast, and
    their rows stay where they are; the rest is a shuffled join without a key
    that many rows share. The count column is left out.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = keys.filter(F.col(count) > max(1000, total // HOT_SHARE)).drop(count)
    cold = keys.filter(F.col(count) <= max(1000, total // HOT_SHARE)).drop(count)
    few = F.broadcast(Table(hot, "hot-keys").df)
    return df.join(few, on).unionByName(df.join(few.select(*on), on, "left_anti").join(cold, on))


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limit the Arrow batches that Python workers get, by rows and by bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def scatter(df: DataFrame, *columns: str) -> DataFrame:
    """Deal the rows out evenly by a hash of key columns; the key of a row is fixed, so retries agree.

    A table whose files are few (large row groups) would else keep most cores idle.
    """
    return df.repartition(*[F.xxhash64(*columns)])


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lean(run):
    """A mapInArrow function that gives its memory back to the system when its partition ends.

    Workers live on for later stages, and what they keep would count against those.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that the given edges connect each with (vectorised hooking)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


#: Edges that one task contracts at once (16 MB).
EDGES = 1_000_000
EDGE = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by a star for each of its components; memory is bounded by blocks of edges."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        nodes, roots = local_roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
        own = nodes != roots
        return batch(EDGE, nodes[own], roots[own])

    n = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= EDGES:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of the edges (two long columns): root is the smallest node reachable.

    Each round contracts edges within partitions of up to EDGES edges, hooks a
    node's other roots to its smallest one and halves paths; rounds grow with the
    logarithm of the longest path. A partition that holds all edges left is
    contracted to the result at once. Nothing is collected: only counts reach
    the driver. A node that is its own root isn't listed. No edges: an empty table.
    """
    a, b = edges.columns[:2]
    own = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).filter("node <> root")
    last = Table(own, "edges")
    while True:
        parts = -(-last.df.count() // EDGES)
        stars = Table(last.df.select("node", "root").coalesce(max(1, parts)).mapInArrow(_contract, "node long, root long"), "stars")
        last.drop()
        if parts <= 1:
            return stars.df
        least = stars.df.groupBy("node").agg(F.min("root").alias("least"))
        merged = stars.df.join(least, "node").filter("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        up = least.select(F.col("node").alias("root"), F.col("least").alias("above"))
        halved = least.withColumnRenamed("least", "root").join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().cast("int").alias("open"))
        last = Table(halved.unionByName(merged.distinct().withColumn("open", F.lit(1))), "forest")
        stars.drop()
        if not last.df.filter("open = 1").limit(1).count():
            return last.df.select("node", "root")
