"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwell.llm.runtime import apart, cut


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, its root) of every node that isn't a root."""
        nodes = [x for x in self.parent if self.find(x) != x]
        return np.array(nodes, np.int64), np.array([self.parent[x] for x in nodes], np.int64)


#: Nodes that a task's forest holds before its edges are handed on.
LOCAL_NODES = 500_000
#: Edges, counted, up to which one task's forest ends the work; more go on in star steps.
LOCAL_EDGES = 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to the stars of their forest."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > LOCAL_NODES:
            yield _star(forest)
            forest = Forest()
    yield _star(forest)


def _star(forest: Forest) -> pa.RecordBatch:
    hi, lo = forest.edges()
    return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge that isn't the smallest of its component; component is that smallest one.

    edges: two long columns, in any direction, repeated or not. No node's neighbours are gathered: each step is a minimum by
    key and an equi-join, both of which stand a hub.
    """
    a, b = edges.columns
    plain = edges.select(F.col(a).alias("hi"), F.col(b).alias("lo")).where("hi <> lo")
    now = cut(plain.mapInArrow(_contract, "hi long, lo long").distinct())
    if now.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return now.repartition(1).mapInArrow(_contract, "hi long, lo long").select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    state = None
    while True:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(apart("hi").alias("node"), F.least("hi", "m").alias("m"))
        # Large star: a node's larger neighbours go to the smallest of its neighbourhood.
        large = both.join(least.hint("shuffle_merge"), F.col("hi") == F.col("node")).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node's smaller neighbours, and the node, go to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).select(apart("hi").alias("node"), "m")
        small = large.join(low.hint("shuffle_merge"), F.col("hi") == F.col("node")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(small.unionByName(low.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        state = (seen.n, seen.h)
