"""Connected components of a graph of any size, by alternating large and small stars.

Tasks first contract their own edges. Then each round joins every node with the least node that it or its neighbours see, first towards larger neighbours, then towards smaller ones;
the edges turn into one star for each component, around its least node. Rounds are written to the shared folder, so a lost
executor repeats one round at most. Neighbour lists are never gathered: a round is aggregations (summed in the map tasks) and joins whose
hot keys the skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged

#: Edges that one task turns into a forest of its own before the rounds.
TOGETHER = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges: each node with the least one of its tree."""
    up: dict[int, int] = {}
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for v in (x, y):
                up.setdefault(v, v)
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes, roots = [], []
    for v in up:
        x = v
        while up[x] != x:
            x = up[x]
        if x != v:
            nodes.append(v)
            roots.append(x)
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)], pa.int64()), pa.array(roots[i : i + (1 << 16)], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, together: int = TOGETHER, limit: int = 60) -> DataFrame:
    """edges: long columns a and b, in any order, repeats and loops allowed. Gives id and component (the least id reachable) of every node
    that has an edge to another; nodes that are their own least are left out.

    Tasks first turn `together` edges each into forests; where one task has seen all edges, nothing is left for the rounds."""
    e = edges.where("a <> b").select("a", "b")
    tasks = -(-e.count() // together)
    e = staged((e.coalesce(1) if tasks < 2 else e.repartition(tasks)).mapInArrow(_forest, "u long, v long").distinct(), "edges")
    state = _state(e)
    if not state[0] or tasks < 2:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(limit):
        last = e
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large_star")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before, state = state, _state(e)
        discard(edges.sparkSession, last, least, large, low)
        if state == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def _state(e: DataFrame) -> tuple:
    """Count and order-free digest of the edges: equal when a round changed nothing."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)
