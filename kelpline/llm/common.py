"""Session settings and small helpers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"kelpline-checkpoints-{os.getuid()}")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries begun within drop their shuffle files when they end; for those that write their result to the shared folder."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has Spark's cleaner drop the checkpoint files of frames that nothing refers to any more.

    The cleaner acts when the driver's JVM collects its garbage, which may be long after a large table was read
    last.
    """
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Number of buckets of a packed exchange: the session's shuffle partitions, which follow the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_id(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as BIGINT and the named columns alone, so that no extra column can clash; rows without a doc_id go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).where(F.col("doc_id").isNotNull())


def to_buckets(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Sends the rows of bucket b to partition b of n."""
    return df.repartitionById(n, F.col(column))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def hand_back() -> None:
    """Returns memory that was freed in this process, but that the allocators of C and Arrow keep, to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, which hands its memory back when it has ended.

    Workers outlive their tasks, so what idle ones keep adds to the memory of the stages that follow.
    """

    @wraps(task)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(it)
        hand_back()

    return run


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)


def unpack(column, dtype) -> np.ndarray:
    """The arrays of a binary column, end to end."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and where each of the n buckets begins in it."""
    bucket = bucket.astype(np.uint16 if n <= 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each of count, end to end."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


def all_pairs(begin: np.ndarray, n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places of each group of n that stands at begin, some most of them at once."""
    # each place, and how many of its group come after it
    place, after = expand(begin, n), np.repeat(n, n) - 1 - expand(np.zeros(len(n), np.int64), n)
    at, cost = 0, np.append(0, np.cumsum(after))
    while at < len(place):
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + most, "right")) - 1)
        yield np.repeat(place[at:end], after[at:end]), expand(place[at:end] + 1, after[at:end])
        at = end


def id_hash(ids: np.ndarray) -> np.ndarray:
    from .textkit import mix

    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes, for the edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        live = low != high
        if not live.any():
            break
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@tidy
def spanning(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars: every node of a component to its least, so at most one edge a node."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = map(np.concatenate, zip(*parts))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_components(len(nodes), index[: len(a)], index[len(a) :])
        other = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[other], nodes[label[other]]

    for batch in batches(it):
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > 2_000_000 + 2 * len(a):
            a, b = stars([(a, b), *held])
            held = []
    if held:
        a, b = stars([(a, b), *held])
    if len(a):
        yield rows(EDGES, a=a, b=b)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for edges (a, b) of BIGINT without nulls: large-star and small-star rounds; component is the least node.

    Tasks first put their own edges in stars.  Every round is checkpointed, and the number of rounds follows the
    logarithm of the longest path.  The least neighbour of a node is an aggregate that joins back, so that no
    task holds the neighbourhood of a hub.
    """

    def lowest(e: DataFrame) -> DataFrame:
        """(u, v) with the least v of each u."""
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        return lowest(both).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        low = lowest(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        pairs = low.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b")
        return pairs.where("a <> b").distinct()

    edges = checkpointed(edges.where("a <> b").select("a", "b").mapInArrow(spanning, "a long, b long").distinct())
    state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())
    for _ in range(max_rounds if state[0] else 0):
        edges = checkpointed(small(large(edges)))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
