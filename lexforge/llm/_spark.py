"""Spark helpers shared by the operators: durable intermediate tables, packed columns, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.storage import stored


def parts_of(spark: SparkSession) -> int:
    """Buckets of packed exchanges: a multiple of the session's shuffle partitions."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Give back what a task leaves in this Python worker: the next stages share the executor with it."""
    from . import _text

    _text.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a glibc system
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of record batches that gives its memory back when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame; integers are split into byte planes, which compress better."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], dtype=np.int64)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + body)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 * (2 * n + 1)
    for (width, length), kind in zip(sizes.tolist(), types, strict=True):
        planes = np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1) if width > 1 else planes.reshape(-1).view(kind))
        at += width * length
    return out


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b) links -> (node, root): root is the least node reachable.

    Each round every node takes the least label among its neighbours' and its own, then
    jumps to that label's label, so chains shorten by halves. A round's labels are a
    written table, which both cuts lineage and survives lost executors. Labels are
    merged with partial aggregation, so a node with very many links is no hot task.
    """
    both = stored(edges.selectExpr("a", "b").union(edges.selectExpr("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("top"))
        nxt = stored(step.join(up, step.root == up.via, "left").select("node", "old", F.coalesce("top", "root").alias("root")), "labels")
        moved = nxt.filter(F.col("old") != F.col("root")).limit(1).count()
        labels = nxt.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of roots after further links (a, b): each link stands for one between its ends' classes.

    Links that roots already holds are not gone through again, so a large class costs its
    links once, however often others are added.
    """
    if roots is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(f"{end}_node"), F.col("root").alias(f"{end}_root"))
        ends = ends.join(own, ends[end] == own[f"{end}_node"], "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_node", f"{end}_root")
    up = components(ends.filter("a <> b"))
    tops = up.select(F.col("node").alias("via"), F.col("root").alias("top"))
    known = roots.join(tops, roots.root == tops.via, "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(known.union(up.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
