import numpy as np
import pytest

from factloom.llm import cap_filters as C
from factloom.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, kept string"


def _brute(ids, x, cosine=0.9):
    """(links, component) of each row by comparing all."""
    x = np.array(x, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], label.max()).min(1))
        if (new == label).all():
            return near.sum(1), label
        label = new


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    links, label = _brute([r.vec_id for r in rows], [r.embedding for r in rows])
    want = {r.vec_id: (n, c) for r, n, c in zip(rows, links, label, strict=True)}
    out = C.op8_cap_filters(spark, "/root/testdata/sf0.1").collect()
    assert len(out) == len(rows)
    assert sum(r.n_links for r in out) >= 0.99 * links.sum() and all(r.n_links <= want[r.vec_id][0] for r in out)
    assert np.mean([r.component_id == want[r.vec_id][1] for r in out]) > 0.999
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_recall_at_the_least_cosine():
    pick = np.random.default_rng(4)
    for length, count in ((64, 1000), (64, 50_000), (128, 100_000), (8, 500), (3, 100)):
        code, shared = C.Filters(length, count, 0.9), 0
        for _ in range(200):
            x, y = pick.standard_normal((2, length))
            x /= np.linalg.norm(x)
            y -= (x @ y) * x
            y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y)
            shared += bool(np.intersect1d(code.passed(x), code.passed(y)).size)
        assert shared >= 190, (length, count, shared)


@pytest.mark.parametrize("count", [3_000_000, 20_000_000])
def test_recall_of_tables_too_large_to_be_tried(count):
    code, pick = C.Filters(64, count, 0.9), np.random.default_rng(9)
    x, y = pick.standard_normal((2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    passed = [(code.passed(a), code.passed(b)) for a, b in zip(x, y, strict=True)]
    assert sum(np.intersect1d(a, b).size > 0 for a, b in passed) >= 285
    assert 100 < np.mean([len(a) for a, _ in passed]) / (C.CODES * code.words**3) * count < 200  # vectors of a filter


def test_list_decoding_finds_all_filters():
    code = C.Filters(24, 3000, 0.9)
    x = np.random.default_rng(1).standard_normal(24)
    x /= np.linalg.norm(x)
    n, want = code.words, []
    for c, (rotation, words) in enumerate(code.codes):
        turned = x @ rotation
        parts = [w @ turned[a:b] for w, a, b in zip(words, code.cuts, code.cuts[1:], strict=False)]
        total = parts[0][:, None, None] + parts[1][None, :, None] + parts[2][None, None, :]
        i, j, k = np.nonzero(total >= code.threshold)
        want += (c * n**3 + (i * n + j) * n + k).tolist()
    assert code.passed(x).tolist() == sorted(want)


def test_large_groups_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    pick = np.random.default_rng(2)
    near = pick.standard_normal(16) + 0.05 * pick.standard_normal((120, 16))
    x = np.concatenate([near, pick.standard_normal((60, 16)), near[:1].repeat(40, 0)]).astype(np.float32)
    ids = pick.permutation(len(x)).tolist()
    links, label = _brute(ids, x)
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in zip(ids, x, strict=True)], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(df).collect()}
    assert out == {i: (n, c) for i, n, c in zip(ids, links.tolist(), label.tolist(), strict=True)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, ""), (2, [], ""), (3, [0.0, 0.0], ""), (4, [1.0, None], ""), (5, [nan, 1.0], ""), (6, [inf, 1.0], ""), (7, [1.0, 0.0], ""),
            (8, [2.0, 0.1], ""), (8, [2.0, 0.1], ""), (9, [1.0, 0.0, 0.0], ""), (None, [1.0, 0.0], ""), (10, [-1.0, 0.0], "")]
    out = C.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out.collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
    assert got == sorted([*alone, (0, 0, 0, False), (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False)])
    assert C.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    edges = [*path, *((100, i) for i in range(101, 140)), (201, 200), (202, 201), (200, 202), (300, 300), (59, 60)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    want = {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert {r.node: r.component for r in components(df).collect()} == want


def test_equal_cosines_at_the_threshold(spark):
    """Ties: many pairs of one cosine, and lengths with few vectors, which meet without filters."""
    side = float(np.float32(np.sqrt(0.19)))
    rows = [(1, [1.0, 0.0, 0.0], "")] + [(i, [0.9, side * (-1) ** i, 0.0], "") for i in range(2, 8)] + [(20 + i, [0.0, 0.0, float(i), 1.0], "") for i in range(6)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for group in (rows[:7], rows[7:]):
        links, label = _brute([r[0] for r in group], np.array([r[1] for r in group], np.float32))
        assert {r[0]: out[r[0]] for r in group} == {r[0]: (n, c) for r, n, c in zip(group, links.tolist(), label.tolist(), strict=True)}


def test_very_large_and_small_components_keep_their_direction(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [3e-300, 3e-300]), (4, [1e200, -1e200]), (5, [5e-324, 0.0]), (6, [1e308, 0.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_the_exact_way_finds_every_link(spark):
    pick = np.random.default_rng(6)
    x = pick.standard_normal((1400, 24))
    y = 0.9 * x / np.linalg.norm(x, axis=1, keepdims=True) + 0.4 * pick.standard_normal(x.shape) / np.sqrt(24)
    vectors = np.concatenate([x, y])
    links, label = _brute(range(len(vectors)), vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(df, exact=True).collect()}
    assert out == {i: (n, c) for i, (n, c) in enumerate(zip(links.tolist(), label.tolist(), strict=True))} and links.sum() > 100
