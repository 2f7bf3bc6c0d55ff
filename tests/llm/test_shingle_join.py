import random
import re
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import shingle_join as J

SCHEMA = "doc_id long, text string, component_id string"


def _set(text, words):
    found = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def _brute(rows, words, num, den):
    sets = [_set(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted((k or 0, len(s), least.get(root(i)) or 0) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def _run(spark, rows, words, num, den):
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA)
    out = J.similar_groups(df, words=words, num=num, den=den)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out.collect())


def _copies(pick, count, vocabulary=400):
    """Texts of all lengths, with copies that differ in some words, chains of them, and a passage that many share."""
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for _ in range(count):
        text = [f"w{pick.randrange(vocabulary)}" for _ in range(pick.choice([1, 3, 4, 5, 8, 10, 14, 18, 25, 60, 200]))]
        for _ in range(pick.choice([1, 1, 2, 4])):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(pick.randrange(4)):
                text[pick.randrange(len(text))] = f"W{pick.randrange(vocabulary)}"
            if pick.random() < 0.1:
                text += passage.split()
    keys = pick.sample(range(1, 10 * len(rows)), len(rows))
    return list(zip(keys, rows, strict=True))


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80), (1, 85), (2, 60)])
def test_random_copies_match_brute_force(spark, words, num):
    rows = _copies(random.Random(words + num), 90)
    assert _run(spark, rows, words, num, 100) == _brute(rows, words, num, 100)


def test_frequent_grams_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(J, "AT_LEAST", 3)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "CHUNK", 8)
    pick = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):  # one group of near copies, some of them linked only through others
        text = list(base)
        for _ in range(pick.randrange(9)):
            text[pick.randrange(len(text))] = f"x{pick.randrange(50)}"
        rows.append((i + 1, " ".join(text)))
    rows += [(1000 + k, t) for k, t in _copies(pick, 20)]
    assert _run(spark, rows, 3, 85, 100) == _brute(rows, 3, 85, 100)


def _families(monkeypatch, sets, keys, rule, block=16):
    """(first of family, members' arrays): what ``_lead`` says of one list of these sets, in blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "map_batches", lambda df, schema, fn: fn)
    monkeypatch.setattr(J, "written", lambda fn, label: fn)
    rows = sorted((len(x), k, *J.sketch(x)) for x, k in zip(sets, keys, strict=True))
    n, c, s, s2 = (np.array(x) for x in zip(*rows, strict=True))
    columns = {"e": np.ones(len(n), np.int64), "o": np.zeros(len(n), np.int32), "n": n.astype(np.int32), "c": c, "s": s, "s2": s2.astype(np.int32)}
    table = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    label = {k: k for k in keys}
    for out in J._lead(MagicMock(), rule)(table.slice(i, 4) for i in range(0, len(n), 4)):
        for u, v in zip(out["u"], out["v"], strict=True):
            old, new = label[u], label[v]
            label = {k: new if x == old else x for k, x in label.items()}
    return label, (c, n, s, s2)


def _hashes(pick, count):
    return pick.integers(1, 2**63, count).astype(np.uint64)


def test_a_chain_by_size_is_one_family_across_blocks(spark, monkeypatch):
    pick = np.random.default_rng(3)
    y = _hashes(pick, 110)
    sets = [np.sort(y[:90]), np.sort(y[:100]), *(np.unique(_hashes(pick, 100 + i // 10)) for i in range(95)), np.sort(y)]
    label, _ = _families(monkeypatch, sets, [1, 2, *range(10, 105), 3], J.Rule(85, 100))
    assert label[1] == label[2] == label[3] and len(set(label.values())) == 96


@pytest.mark.parametrize("seed", range(12))
def test_what_is_near_in_a_list_is_one_family(spark, monkeypatch, seed):
    pick, rule, sets = np.random.default_rng(seed), J.Rule(85, 100), []
    for _ in range(12):  # chains that grow, among sets of their own
        whole = _hashes(pick, 140)
        sets += [np.sort(whole[:m]) for m in pick.choice(np.arange(70, 140), pick.integers(2, 6), replace=False)]
    sets += [np.sort(_hashes(pick, m)) for m in pick.integers(70, 140, 60)]
    keys = pick.permutation(len(sets)).tolist()
    label, (c, n, s, s2) = _families(monkeypatch, sets, keys, rule)
    for i in range(len(c)):
        assert {label[k] for k in c[J._near(n.astype(np.int64), s, s2, i, rule)].tolist()} == {label[int(c[i])]}


@pytest.mark.parametrize(("bit", "bit2"), [(-(2**63), 0), (0, -(2**31)), (-(2**63) + 5, -(2**31) + 3)])
def test_sketches_that_differ_in_a_sign_are_near(bit, bit2):
    s, s2 = np.array([9, 9 ^ bit], np.int64), np.array([7, 7 ^ bit2], np.int32)
    assert J._near(np.array([100, 101]), s, s2, 0, J.Rule(85, 100)).all()


def test_linked_pairs_whose_sketches_differ_in_a_sign(spark):
    pick, rows = random.Random(41), []
    while len(rows) < 120:  # pairs that nothing else joins
        text = [f"w{len(rows)}_{i}" for i in range(80)]
        other = [*text[:-8], *(f"v{pick.randrange(10**9)}" for _ in range(8))]
        a, b = (J.sketch(J.shingle_sets([" ".join(x)], 4)[0]) for x in (text, other))
        if (a[0] < 0) != (b[0] < 0) or (a[1] < 0) != (b[1] < 0):
            rows += [(len(rows) + 1, " ".join(text)), (len(rows) + 2, " ".join(other))]
    assert _run(spark, rows, 4, 80, 100) == _brute(rows, 4, 80, 100)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = J.op1_shingle_join(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == _brute(rows, 4, 85, 100)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (5, "one"), (None, "one"), (None, "alone here"), (6, "a b c"), (6, "x y z"),
            (7, "Été a"), (8, "été a"), (9, "a\x0bb\x0cc"), (10, "a　b c"), (11, " ".join(f"v{i}" for i in range(60_000)))]
    assert _run(spark, rows, 4, 85, 100) == _brute(rows, 4, 85, 100)
    assert _run(spark, [], 4, 85, 100) == []


def test_sets_do_not_depend_on_the_batch():
    texts = ["a b c d e", "", "q", "the end of the day", "A b C d e"]
    together = J.shingle_sets(texts, 3)
    assert all(np.array_equal(x, J.shingle_sets([t], 3)[0]) for x, t in zip(together, texts, strict=True))
    assert np.array_equal(together[0], together[4]) and [len(x) for x in together] == [3, 0, 1, 3, 3]


def test_the_boundary_follows_the_costs():
    rule = J.Rule(85, 100)
    assert J.boundary({8: 100_000, 4: 10}, rule) == 9  # 9 subsets against 2 entries
    assert J.boundary({18: 1000}, rule) < 16  # hundreds of subsets against 3 entries
    assert rule.subsets(6) == 1 and rule.subsets(7) == 8
