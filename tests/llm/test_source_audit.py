import random
import re
from collections import Counter

import duckdb
import numpy as np

from factloom.llm import source_audit as A

SCHEMA = "doc_id long, text string, lang string, source string, rank string, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows):
    docs, said, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [x.translate(LOWER) for x in TERM.findall(text or "")]
        said.update((lang, source, x) for x in terms)
        docs.update((lang, x) for x in set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(x for (of, x), n in docs.items() if of == lang and n >= 3)
        sources = [s for of, s in groups if of == lang]
        n = {s: sum(said[lang, s, x] for x in kept) for s in sources}
        share = lambda count, total: 1 + 10**9 * (count + 1) // (total + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        p = {(s, x): share(said[lang, s, x], n[s]) for s in sources for x in kept}
        q = {x: share(sum(said[lang, s, x] for s in sources), sum(n.values())) for x in kept}
        for s in sources:
            pairs = [(t, sum(f(p[s, x], p[t, x]) for x in kept)) for t in sources if t != s]
            terms = [(x, f(p[s, x], q[x])) for x in kept if said[lang, s, x] and p[s, x] > q[x]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, x, v, i) for i, (x, v) in enumerate(found, 1) if part == "pair" or i <= 200]
    return sorted(out)


def _run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, A.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))


def _rows(seed, docs, langs="abc", sources=5, words=60):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("aBcÉßжñ中𝒳") for _ in range(pick.randint(1, 4))) for _ in range(words)]
    text = lambda: "".join(pick.choice(vocabulary) + pick.choice(" \t-1\x7f[`@\n") for _ in range(pick.randint(0, 30)))
    return [(i, text(), pick.choice(langs), f"s{pick.randrange(sources)}") for i in range(docs)]


def test_random_texts_match_brute_force(spark):
    rows = _rows(1, 60)
    rows += [(70, None, "a", "s0"), (71, "", None, None), (72, "lone words", None, "s1"), (73, "alone", "one", "only"), (74, "Alone", "one", "only")]
    rows += [rows[0], rows[0], rows[3]]  # repeated rows count
    assert _run(spark, rows) == _brute(rows)


def test_chunks_blocks_and_flushes_change_nothing(spark, monkeypatch):
    rows = _rows(2, 50, "ab", 7)
    want = _brute(rows)
    for name, value in (("CHUNK", 3), ("CELLS", 4), ("HELD", 10), ("STRETCH", 5), ("ENTRIES", 4), ("RANKS", 200)):
        monkeypatch.setattr(A, name, value)
    assert _run(spark, rows) == want
    monkeypatch.setattr(A, "MAX_PAIRS", 1)
    assert _run(spark, rows) == want


def test_more_terms_than_ranks_and_ties(spark):
    rows = [(i, " ".join(f"t{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(300)), "x", "s1") for i in range(3)]
    rows += [(9 + i, "zz zz", "x", "s2") for i in range(3)]
    got = _run(spark, rows)
    assert got == _brute(rows) and sum(r[1:3] == ("s1", "term") for r in got) == 200


def test_languages_without_kept_terms_have_their_pairs(spark):
    got = _run(spark, [(1, "one", "x", "b"), (2, "two", "x", "a"), (3, None, "x", "c")])
    assert got == [("x", s, "pair", t, 0, i) for s in "abc" for i, t in enumerate([t for t in "abc" if t != s], 1)]


def test_empty_table(spark):
    assert _run(spark, []) == []


def test_shares_of_counts_beyond_64_bits():
    counts, totals = [0, 1, 10**10, 10**13, 3 * 10**14], [10**15, 7 * 10**14]
    for total in totals:
        assert A.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]
    assert A.exact_bincount(np.array([0, 0, 1]), np.array([2**60, 3, 2**53 + 1]), 2).tolist() == [2**60 + 3, 2**53 + 1]


def test_long_text_is_cut_where_terms_end():
    text = ("é" * 999 + " word-") * 4000
    assert len(text.encode()) > 4 * A.STRETCH
    found = [w for words in A.terms_of(text.encode()) for w in words]
    assert Counter(found) == {("é" * 999).encode(): 4000, b"word": 4000}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(A.OP11_SQL).fetchall())
    got = sorted(map(tuple, A.op11_source_audit(spark, "/root/testdata/sf0.001").select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == want and len(got) > 1000
