"""Connected components of a distributed edge list: union-find inside tasks, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import drop_scratch, materialise

#: Edges that a task's union-find holds before it is emptied.
LOCAL_EDGES = 500_000


class UnionFind:
    """Sets of integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to stars (root, member) of what this task can join."""

    def stars(uf: UnionFind) -> pa.RecordBatch:
        pairs = [(uf.find(x), x) for x in list(uf.up)]
        got = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=_EDGE)

    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uf.union(a, b)
        if len(uf.up) > LOCAL_EDGES:
            yield stars(uf)
            uf = UnionFind()
    yield stars(uf)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable. Rounds: logarithmic in the size
    of the largest component. Edges are only ever held by the executors."""
    now = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(local_forest, "a long, b long"), "stars")

    def mark(df: DataFrame):
        # two sums of 64-bit hashes without overflow: edge sets that differ agree in them once in 2^100 and more
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(20,0)"))).first()

    before = mark(now)
    while before[0]:
        # large star: each node's larger neighbours go to its smallest neighbour
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("x"), "b")
        pairs = small.select("a", F.col("x").alias("b")).unionAll(small.select("a", "b")).where("a <> b").distinct()
        nxt = materialise(pairs, "stars")
        after = mark(nxt)
        drop_scratch(now)
        now = nxt
        if after == before:
            break
        before = after
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
