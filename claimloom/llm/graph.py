"""Connected components: alternating stars by joins and aggregations, or one task for few edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import durable

#: Edges that one task may hold (16 bytes each); beyond that, the stars do the same work.
ONE_TASK = 1 << 22


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes, and the smallest node that each is connected with."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [x for x in batches if x.num_rows]
    if held:
        u, v = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        found = pa.RecordBatch.from_arrays([pa.array(x) for x in smallest(u, v)], ["node", "component"])
        yield from (found.slice(at, 1 << 16) for at in range(0, found.num_rows, 1 << 16))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of node and neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    moved = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(u, v)`` of longs.

    A component is named by its smallest node.  Counted edges up to ``one_task`` go through one
    task, which spares the many small jobs of the stars.  Both star steps write down their edges, of
    which there are never more than at the start, so no lineage grows; a node with very
    many neighbours is met only by aggregations that combine before the shuffle and by
    joins that adaptive execution splits.  Self links and repeats are allowed; an empty
    table gives an empty result.
    """
    both = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if edges.count() <= one_task:
        return both.coalesce(1).mapInArrow(_at_once, "node long, component long")
    now = durable(both.distinct())
    state = _state(now)
    while True:
        now = durable(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
