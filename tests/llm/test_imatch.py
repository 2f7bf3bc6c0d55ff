import hashlib
from collections import Counter

import numpy as np

from factloom.llm import imatch as M

SCHEMA = "doc_id long, text string, fingerprint string"


def _edited(rows):
    """(id, edited text, next text) by the definition."""
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: -r[0])
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        yield key, text[: len(text) - len(text) // 3] + after[: len(text) // 3], after


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = {r.doc_id: r for r in M.op7_imatch(spark, folder).collect()}
    assert set(out) == {k for k, _ in docs}
    texts = dict(docs)
    for key, edited, after in _edited(docs):
        r = out[key]
        assert r.n_chars == len(texts[key]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == M.likeness(M.read(r.fingerprint), M.read(out[next(k for k, t in docs if t == after)].fingerprint))
        assert r.near_edited == M.likeness(M.read(r.fingerprint), M.read(r.edited_fingerprint))
    near, far = np.array([r.near_edited for r in out.values()]), np.array([r.near_next for r in out.values()])
    assert (near > far).mean() > 0.93 and np.median(near) > 0.3 and np.median(far) < 0.05
    by_text = {}
    assert all(by_text.setdefault(texts[k], r.fingerprint) == r.fingerprint for k, r in out.items())


def test_document_shares_are_exact(spark):
    texts = ["a b, B c", "b. c", None, "", "a a a"]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    want = Counter(M.hash_of(t) for x in texts for t in {M.term_of(w) for w in (x or "").split()})
    assert {r.term: r.n for r in M.document_shares(df, "text").collect()} == want
    assert M.lexicon(df, low=0.3, high=0.5).tolist() == sorted(M.hash_of(t) for t in "abc")


def test_ranges_hand_over_their_first_document(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    rows = [(i * 7 % 101, " ".join(f"w{j}" for j in range(i, i + 9 + i % 5)), "x") for i in range(40)]
    out = M.edited_fingerprints(spark.createDataFrame(rows, SCHEMA), np.zeros(0, np.int64)).collect()
    want = {k: e for k, e, _ in _edited(rows)}
    assert {r.doc_id: r.edited for r in out} == want and len(out) == 40


def test_odd_rows(spark):
    run = lambda rows: M.edited_fingerprints(spark.createDataFrame(rows, SCHEMA), np.zeros(0, np.int64)).collect()
    one = run([(5, "abcdef", "")])
    assert [(r.doc_id, r.edited, r.near_next) for r in one] == [(5, "abcdab", 1.0)]
    assert run([]) == []
    out = run([(1, None, ""), (2, "", ""), (3, "é" * 9, ""), (3, "é" * 9, ""), (None, "x y", "")])
    assert sorted((r.doc_id or 0, r.edited) for r in out) == [(0, "x y"[:2] + "é"), (1, ""), (2, ""), (3, "é" * 6), (3, "é" * 9)]
    shown = M.fingerprints(spark.createDataFrame([(1, "x y", "clash")], SCHEMA), np.zeros(0, np.int64))
    assert shown.columns == ["doc_id", "text", "fingerprint"] and M.likeness(*[M.read(shown.first().fingerprint)] * 2) == 1.0


def _plain_hashes(text, band):
    """The fingerprint's parts by plain loops over the text's terms, without the module's tables."""
    terms = {M.hash_of(t) or 1 for w in text.split() if (t := M.term_of(w))}
    kept = {t for t in terms if t in band}
    if len(kept) < M.FEW:
        kept = terms
    level, full = len(kept).bit_length(), 2**64
    mix = lambda x: int(M._mix(np.array([x % full], np.uint64))[0])
    out = []
    for i in (0, 1):
        row = []
        for factor in M._FACTORS.tolist():
            held = [t % full for t in kept if t % full * factor % full < 2 ** (64 - level - i)]
            row.append(max(1, mix(sum(mix(t) | 1 for t in held)) >> 32) if held else 0)
        out.append(row)
    return level, out


def test_fingerprints_are_those_of_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    share = Counter(M.hash_of(t) or 1 for r in rows for t in {M.term_of(w) for w in r.text.split()} - {""})
    low, high = max(2, -(-len(rows) * M.LOW // 1)), len(rows) * M.HIGH // 1
    band = {t for t, n in share.items() if low <= n <= high}
    assert set(M.lexicon(docs).tolist()) == band
    out = {r.doc_id: r for r in M.op7_imatch(spark, folder).collect()}
    edited = {k: e for k, e, _ in _edited([(r.doc_id, r.text) for r in rows])}
    for r in rows[:60]:
        for text, shown in ((r.text, out[r.doc_id].fingerprint), (edited[r.doc_id], out[r.doc_id].edited_fingerprint)):
            level, parts = _plain_hashes(text, band)
            assert shown == f"{level:02x}" + "".join(f"{h:08x}" for row in parts for h in row)


def test_extreme_ids_long_texts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 4)
    long = "some words of a very long text " * 40_000
    rows = [(-(2**63), "lowest a b c", ""), (-(2**63) + 1, "next to it d e f", ""), (2**63 - 1, "highest g h i", ""), (0, long, ""), (-1, "minus one j k", ""), (1, "", ""), (2, None, "")]
    rows += [(7, f"many rows of one id {i} " * (1 + i % 3), "") for i in range(60)] + [(None, f"null {i} x y z", "") for i in range(30)] + [(9, "all the same", "")] * 25
    out = M.edited_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5), np.zeros(0, np.int64)).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1] or ""]))
    want = Counter()
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        want[r[0], own[: len(own) - len(own) // 3] + after[: len(own) // 3]] += 1
    assert Counter((r.doc_id, r.edited) for r in out) == want
