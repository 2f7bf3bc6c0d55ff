import random

import pytest

from factloom.operators import graph as G
from factloom.operators import resolution as R


def _loop(nodes, edges):
    earlier = {}
    for a, b in edges:
        earlier.setdefault(max(a, b), []).append(min(a, b))
    new = set()
    for n in sorted(nodes):
        if not any(a in new for a in earlier.get(n, ())):
            new.add(n)
    return new


def _edges(spark, edges):
    return spark.createDataFrame(edges, "earlier long, later long")


def _new(spark, edges, count):
    out = R.first_come(_edges(spark, edges), spark.range(count))
    rows = out.collect()
    assert len(rows) == count
    return {r.id for r in rows if r.state == "new"}


def test_components_of_random_graphs_stars_and_paths(spark):
    pick = random.Random(2)
    pairs = [(pick.randrange(200), pick.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 60)] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    written = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df, label: written.append(label) or cut(df, label))
    chain = [(i, i + 1) for i in range(1999)]
    random.Random(1).shuffle(chain)
    assert _new(spark, chain, 2000) == set(range(0, 2000, 2))
    assert len(written) < 40


@pytest.mark.parametrize("folded", [10**6, 6, 0])
def test_first_come_with_and_without_rounds(spark, monkeypatch, folded):
    monkeypatch.setattr(G, "FOLDED", folded)
    monkeypatch.setattr(G, "ROUNDS", 2)
    pick = random.Random(folded)
    edges = [tuple(sorted(pick.sample(range(60), 2))) for _ in range(70)] + [(70 + i, 71 + i) for i in range(9)]
    assert _new(spark, edges + edges[:5], 90) == _loop(range(90), edges)


def test_no_edges_and_edges_to_oneself(spark):
    assert _new(spark, [], 3) == {0, 1, 2}
    assert _new(spark, [(1, 1), (2, None)], 3) == {0, 1, 2}


def test_ids_of_text(spark):
    out = R.first_come(spark.createDataFrame([("a", "b"), ("b", "c")], "earlier string, later string"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert {tuple(r) for r in out.collect()} == {("a", "new"), ("b", "review"), ("c", "new")}
