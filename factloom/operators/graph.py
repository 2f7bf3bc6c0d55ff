"""Graphs of records as tables of edges: components, and who comes first among neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.cut import cut, let_go

#: Edges of a component that are folded in one task; larger ones are thinned out in rounds first.
FOLDED = 2_000_000
#: Rounds between two looks at what components are left.
ROUNDS = 4


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (u, v) lead to, for every node that has one, but itself.

    Nodes point to smaller ones. In turn, all larger neighbours of a node, and all smaller ones, come to point to the smallest around
    it, which halves what is left of a path; a number of written tables in proportion to its logarithm, then, for any graph."""
    now, before = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "pointers"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        old, now = now, cut(smaller.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "pointers")
        let_go(old)


def _fold(edges: DataFrame) -> DataFrame:
    """(id): of edges (component, earlier, later), the later ones with an earlier neighbour that isn't one of these itself.

    Each component streams by in the order of its nodes; a task holds those found of one component."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, node, found = None, None, set()
        for part in parts:
            out = []
            for c, earlier, later in zip(part["component"].to_numpy(), part["earlier"].to_numpy(), part["later"].to_numpy(), strict=True):
                if c != component:
                    component, node, found = c, None, set()
                if later != node and earlier not in found:
                    node = later
                    found.add(later)
                    out.append(later)
            yield pd.DataFrame({"id": out})

    kind = dict(edges.dtypes)["later"]
    ordered = edges.select("component", "earlier", "later").repartition("component").sortWithinPartitions("component", "later", "earlier")
    return ordered.mapInPandas(run, f"id {kind}")


def _thinned(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round: neighbours of nodes without an earlier one, and the edges of all others."""
    first = edges.select(F.col("earlier").alias("id")).distinct().join(edges.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
    found = cut(edges.join(first.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct(), "found")
    left = edges.join(found.withColumnRenamed("id", "later"), "later", "left_anti").join(found.withColumnRenamed("id", "earlier"), "earlier", "left_anti")
    return found, cut(left.select("earlier", "later"), "edges")


def behind_first(edges: DataFrame) -> DataFrame:
    """(id): the nodes that come behind a first one. In order of nodes, one is first unless an edge (earlier, later) leads to it from an
    earlier first one. Components are folded each in a task; one that is too large is thinned out in rounds until its
    parts are not."""
    left, found = cut(edges.select("earlier", "later").filter("earlier < later").distinct(), "edges"), None
    while True:
        label = components(left.select(F.col("earlier").alias("u"), F.col("later").alias("v")))
        each = cut(left.join(label, left.later == label.node).select("component", "earlier", "later"), "labelled")
        large = each.groupBy("component").count().filter(F.col("count") > FOLDED).select("component")
        if not large.limit(1).count():
            now = cut(_fold(each), "found")
            return now if found is None else found.union(now)
        large = cut(large, "large")
        now = cut(_fold(each.join(large, "component", "left_anti")), "found")
        found = now if found is None else found.union(now)
        left = each.join(large, "component", "left_semi").select("earlier", "later")
        for _ in range(ROUNDS):
            now, left = _thinned(left)
            found = found.union(now)
