"""Connected components of a link table: local union-find, then star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows
from vitalspan.session import materialize

#: Links that one local forest holds at most, some 150 MB.
FOREST = 1 << 20


class UnionFind:
    """Disjoint sets of integers; the smallest member names its set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars of its local components."""
    def stars(sets: UnionFind) -> pa.RecordBatch:
        nodes = [x for x in sets.up if sets.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], names=["a", "b"])

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.up) >= FOREST:
            yield stars(sets)
            sets = UnionFind()
    yield stars(sets)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` links that is not the
    smallest of its component; the component is its smallest node.

    Links of a task become local stars. As long as they are too many for one
    local forest, alternating star rounds (every node hands its larger
    neighbours, then its smaller ones, to its least neighbour) run on the
    shrunken table until it stops changing; a table that fits a forest is
    finished by one. Only two numbers a round reach the driver.
    """
    edges = materialize(map_rows(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), _forests, "a long, b long"), "links")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state[0] < FOREST:
            edges = materialize(map_rows(edges.coalesce(1), _forests, "a long, b long"), "links")
            break
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "links")
        lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        passed = large.join(lower, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(passed.union(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
