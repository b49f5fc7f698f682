"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: So many edges are finished by one executor task; beyond, star rounds shrink the graph first.
LOCAL_EDGES = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = np.arange(len(nodes)).tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(index[:half].tolist(), index[half:].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(i) for i in range(len(nodes))]]


def _finish(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in part]
    if held:
        nodes, roots = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Large- and small-star rounds run on the executors, each written to the shared
    folder, until nothing changes or the graph is small enough for one bounded
    task (never, with ``local_edges=-1``: DataFrame functions only).  An empty edge table gives no rows; loops and repeated edges do no harm.
    """
    e = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").distinct(), "edges")
    while True:
        count = e.count()
        if not count:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if count <= local_edges:
            return e.coalesce(1).mapInArrow(_finish, "node long, component long")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours of a node are tied to the least of its neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # Small star: the node and its smaller neighbours are tied to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
        after = materialise(small, "edges")
        if after.count() == count and after.exceptAll(e).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        e = after
