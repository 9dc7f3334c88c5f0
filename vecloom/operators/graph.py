"""Connected components by alternating large-star and small-star contraction; small graphs in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.sources.scratch import settled


#: Edges up to which one task finds the components: 16 bytes each.
SMALL = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of a graph that fits in memory, without the roots."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(inv[: len(a)].tolist(), inv[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        up[max(x, y)] = min(x, y)
    root = np.arange(len(nodes))
    for i in range(len(nodes)):  # parents are smaller, so they are final
        root[i] = root[up[i]] if up[i] != i else i
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        node, root = union_find(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = both.join(low, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for the nodes of edges(a, b); component is the smallest node reachable.

    Up to `small` edges one task finds them.  Above, every round is an aggregation with map-side minima and a join, and
    is settled in the shared folder; the driver sees a count and a checksum.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        return r[0], r[1]

    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = state(edges)
    if before[0] <= small:
        return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_in_one, "node long, component long")
    while before[0]:
        edges = settled(_star(_star(edges, True), False), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
