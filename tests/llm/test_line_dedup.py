import random

import duckdb

from factloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_removed string, row string"


def _brute(rows, min_words):
    """Longest earlier copy at each line, for each document; rows: distinct (id, text), ids all different."""
    docs = {}
    for key, text in rows:
        if text is not None:
            docs[key] = [(pos, line) for pos, line in enumerate(text.split("\n")) if line.strip(" ")]
    gone = {key: set() for key in docs}
    places = [(key, i) for key in sorted(docs) for i in range(len(docs[key]))]
    for at, (key, i) in enumerate(places):
        best = 0
        for other, j in places[:at]:
            n = 0
            while i + n < len(docs[key]) and j + n < len(docs[other]) and docs[key][i + n][1] == docs[other][j + n][1]:
                n += 1
            best = max(best, n)
        if sum(len(line.strip(" ").split(" ")) for _, line in docs[key][i : i + best]) >= min_words:
            gone[key] |= set(range(docs[key][i][0], docs[key][i + best - 1][0] + 1))
    return {
        key: None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if pos not in gone[key])
        for key, text in rows
    }


def _run(spark, rows, min_words):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    return L.dedup_lines(df, min_words=min_words)


def test_random_texts_match_brute_force(spark):
    pick = random.Random(5)
    lines = [" ".join(pick.choice("abcdef") for _ in range(pick.randint(1, 4))) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(pick.choice(lines) for _ in range(pick.randint(0, 14)))) for i in range(25)]
    base = rows[3][1]
    rows += [(30, f"{base}\nzz zz zz\n{base}"), (31, None), (32, ""), (33, "\n\n"), (34, base)]
    for min_words in (3, 5, 9):
        want = _brute(rows, min_words)
        got = {r.doc_id: r.text for r in _run(spark, rows, min_words).collect()}
        assert got == want


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(L.OP9_SQL).fetchall())
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.op9_line_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == want and any(r[3] for r in got)


def test_repeated_rows_clashing_names_and_null_keys(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, f"head\n{long}\ntail"), (None, f"{long}\n{long}"), (3, "short"), (4, "short")]
    out = _run(spark, rows, 50)
    assert out.columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in out.collect()))
    assert got == [(0, long, 1), (1, "", 1), (1, "", 1), (2, "head\ntail", 1), (3, "short", 0), (4, "short", 0)]


def test_empty_table_and_plan(spark):
    assert _run(spark, [], 50).count() == 0
    plan = L.op9_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_a_very_long_text_and_ties(spark):
    lines = [f"line {i % 700} of a long text {i % 3}" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "x " * 300_000), (3, "x " * 300_000), (4, "same " * 60), (5, "same " * 60), (6, "same " * 60)]
    out = {r.doc_id: r for r in _run(spark, rows, 50).collect()}
    # the text repeats itself after 2,100 lines; what follows them is a later copy
    assert out[1].n_lines == 20_000 and out[1].n_removed == 20_000 - 2_100 and out[1].text == "\n".join(lines[:2_100])
    assert out[2].text == "x " * 300_000 and out[3].text == "" == out[5].text == out[6].text and out[4].n_removed == 0


def test_ranks_are_those_of_sorted_prefixes(spark):
    pick = random.Random(8)
    rows = [(i, "\n".join(pick.choice("abc") for _ in range(pick.randint(1, 12)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "k long, text string").selectExpr("k", "text", "xxhash64(text) AS th")
    lines = L.suffixes(docs, 8)
    order = {r.line: r.h for r in spark.createDataFrame([(x,) for x in "abc"], "line string").selectExpr("line", "xxhash64(line) AS h").collect()}
    texts = {k: t.split("\n") for k, t in rows}
    distinct = {t: k for k, t in reversed(rows)}  # rows of one text and key are one document; here keys differ
    assert len(distinct) <= len(rows)
    for level, found in enumerate(L.doubled(lines, 8)):
        size, got = 2**level, {(r.k, r.i): r.r for r in found.collect()}
        prefix = {(k, i + 1): tuple(order[x] for x in t[i : i + size]) for k, t in texts.items() for i in range(len(t) - size + 1)}
        often = {p for p in prefix.values() if sum(q == p for q in prefix.values()) > 1}
        assert set(got) == {at for at, p in prefix.items() if p in often}
        by_rank = sorted({(r, prefix[at]) for at, r in got.items()})
        assert len(by_rank) == len(often) == len({r for r, _ in by_rank}) and [p for _, p in by_rank] == sorted(often)


def test_texts_of_very_many_lines_and_stretches(spark):
    import time

    repeated = " ".join(f"r{i}" for i in range(50))
    distinct = "\n".join(f"line number {i} of many" for i in range(100_000))
    islands = "\n".join(f"{repeated} {i}\nown {i}" for i in range(20_000))
    copy = "\n".join(f"{repeated} {i}\nother {i}" for i in range(20_000))
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in _run(spark, [(1, distinct), (2, islands), (3, copy)], 50).collect()}
    assert time.time() - began < 240
    assert got[1][:2] == (100_000, 0) and got[1][2] == distinct and got[2][1] == 0
    assert got[3][:2] == (40_000, 20_000) and got[3][2] == "\n".join(f"other {i}" for i in range(20_000))
