"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import let_go, map_batches, written

#: Nodes that a task joins up before edges are shuffled.
MAX_NODES = 200_000
_EDGES = "u long, v long"


def _forest(edges: DataFrame) -> DataFrame:
    """The edges' components within each stretch of a partition, every node pointing to the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def out() -> dict:
            pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
            return {"u": [x for x, _ in pairs], "v": [r for _, r in pairs]}

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > MAX_NODES:
                yield out()
                parent = {}
        yield out()

    return map_batches(edges, T._parse_datatype_string(_EDGES), run)


def _star(edges: DataFrame) -> DataFrame:
    """Every node's neighbours point to its smallest neighbour, where that is smaller than both."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # large: (node, a smaller node of its component); now each node's smaller neighbours meet in the least
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return small.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes but each component's smallest, from edges (u, v) of long ids in any order."""
    now = written(_forest(edges.select("u", "v").filter("u <> v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.expr("pmod(xxhash64(u, v), 1000000007)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, old = state, now
        now = written(_star(old), "stars")
        let_go(old)
