import hashlib
import random
import re

import duckdb
import numpy as np

from factloom.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, n_words string, bucket string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def _brute(rows):
    split = [(k, WORDS.findall(t or "")) for k, t in rows]
    least = {}
    for k, words in split:
        if k is not None:
            for i in range(len(words) - 49):
                w = tuple(words[i : i + 50])
                least[w] = min(least.get(w, k), k)
    out = []
    for k, words in split:
        gone = set()
        for i in range(len(words) - 49):
            if k is not None and least[tuple(words[i : i + 50])] < k:
                gone |= set(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, S.remove_repeats(df).collect()), key=str)


def _rows(seed, count):
    """Documents of pieces of a few passages, whole copies, and copies that differ in a word."""
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefgh") * pick.randint(1, 3) + pick.choice(["", "é", "\xa0", "中"])
    passages = [[word() for _ in range(pick.randint(30, 160))] for _ in range(6)]
    rows = []
    for _ in range(count):
        words = []
        for _ in range(pick.randint(0, 4)):
            p, kind = pick.choice(passages), pick.random()
            a = pick.randrange(len(p))
            words += p[a:] if kind < 0.4 else p if kind < 0.7 else [word() for _ in range(pick.randint(1, 70))]
        if words and pick.random() < 0.5:
            words[pick.randrange(len(words))] = "x"
        rows.append((pick.randrange(-5, 500), pick.choice([" ", "\n", "\t ", "\x0b\x0c\r"]).join(words)))
    return rows


def test_random_texts_match_brute_force(spark):
    for seed in (1, 2):
        rows = _rows(seed, 60)
        rows += [(600, None), (601, ""), (602, " \n"), (None, rows[0][1]), (None, None), rows[5], (rows[5][0], rows[6][1])]
        got = _run(spark, rows)
        assert got == _brute(rows) and any(r[2] for r in got)


def test_bounds_change_nothing(spark, monkeypatch):
    rows = _rows(3, 40)
    want = _brute(rows)
    for name, value in (("HELD", 100), ("KNOWN", 20), ("STRETCH", 40), ("LEAST", 3)):
        monkeypatch.setattr(S, name, value)
    assert _run(spark, rows, 2) == want


def test_group_of_copies_one_word_texts_and_edges(spark):
    base = " ".join(f"w{i}" for i in range(130))
    rows = [(i, base) for i in range(40)] + [(100, "a " * 300), (101, "a " * 49), (102, "a " * 50), (103, f"x {base} y"), (104, base.replace("w60", "z"))]
    rows += [(200, " ".join(f"w{i}" for i in range(81, 130))), (201, " ".join(f"w{i}" for i in range(80, 130)))]
    got = {r[0]: r for r in _run(spark, rows)}
    assert sorted(got.values(), key=str) == _brute(rows)
    assert got[0][2] == 0 and got[39][2] == 130 and got[103][2] == 130 and got[200][2] == 0 and got[201][2] == 50 and got[102][2] == 50


def test_repeats_at_every_offset(spark):
    """A passage of exactly 50 words is found wherever it lies in both documents."""
    fill = iter(range(10**6))
    fresh = lambda n: [f"f{next(fill)}" for _ in range(n)]
    rows = []
    for offset in range(27):
        passage = [f"p{offset}-{i}" for i in range(50)]
        rows += [(2 * offset, " ".join(fresh(offset) + passage + fresh(3))), (2 * offset + 1, " ".join(fresh(26 - offset) + passage + fresh(1)))]
    got = _run(spark, rows)
    assert got == _brute(rows) and sum(r[2] for r in got) == 27 * 50


def test_long_text(spark):
    words = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words[200_000:], "end"]))]
    got = dict((r[0], r[1:3]) for r in _run(spark, rows))
    assert got == {1: (400_000, 0), 2: (200_002, 200_000)}


def test_empty_table(spark):
    assert _run(spark, []) == []


def test_packed_rows_come_back():
    bucket, doc = np.array([3, 1, 3, 1, 3], np.int32), np.array([-7, -7, 9, 2**40, 2**40])
    place = np.array([5, 1, 70_000, 0, 2**33])
    rows = {r["bucket"]: r for r in S.packed(bucket, doc, place, names=np.arange(5, dtype=np.uint32))}
    assert [x.tolist() for x in S.unpacked(rows[3])] == [[-7, 9, 2**40], [5, 70_000, 2**33]]
    assert [x.tolist() for x in S.unpacked(rows[1])] == [[-7, 2**40], [1, 0]]
    assert np.frombuffer(rows[3]["names"], np.uint32).tolist() == [0, 2, 4]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(S.OP13_SQL).fetchall())
    got = sorted(map(tuple, S.op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()))
    assert got == want and any(r[2] for r in got)
