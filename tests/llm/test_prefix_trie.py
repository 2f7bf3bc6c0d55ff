import hashlib
import random
from collections import defaultdict
from zlib import crc32

import duckdb

from pyspark.sql import functions as F

from factloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _said(role, text):
    role, text = role or "", text or ""
    return role, text


def _digest(said):
    role, text = said
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _brute(rows, borrowed=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", _digest(_said(role, text)), _said(role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6 if borrowed else 0
        lender = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members, nodes = defaultdict(list), set()
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    nodes = sorted(members, key=len)
    out = []
    for x in nodes:
        below = [y for y in nodes if y[: len(x)] == x]
        leaves = [y for y in below if not any(len(z) == len(y) + 1 and z[: len(y)] == y for z in nodes)]
        ends = ",".join(map(str, sorted(c for c in members[x] if len(built[c]) == len(x))))
        out.append((
            min(members[x]), len(x), min(members[x[:-1]]) if x else None, len(members[x]),
            sum(len(y) == len(x) + 1 for y in below), len(leaves),
            sum((len(members[y]) - 1) * len(y[-1][1]) for y in below if y), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1]))


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def _run(spark, rows, borrowed=True):
    turns = P.turns_of(_table(spark, rows))
    if not borrowed:
        got = P.trie(turns)
    else:
        got = P.trie(turns, F.col("conv_id") - F.col("conv_id") % 100, (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"), 5)
    return sorted(map(tuple, got.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def _rows(seed, convs):
    pick = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(pick.randint(1, 9)):
            rows.append((c, pick.choice([t, t, t, None, 3]), pick.choice(["user", "bot", None]), pick.choice(["a", "bb", "", None, "çé𝒳"])))
    return rows


def test_random_conversations_match_brute_force(spark):
    rows = _rows(1, [0, 1, 2, 3, 17, 99, 100, 101, 150, 205, 207, 299, -5, -100, -150])
    rows += rows[:4]  # repeated rows are turns each
    rows += [(None, 1, "user", "of none")]
    for borrowed in (True, False):
        got = _run(spark, rows, borrowed)
        assert got == _brute(rows, borrowed)
    assert len({r[:2] for r in got}) == len(got)


def test_turnless_conversations_end_at_the_root(spark):
    # 205 borrows from 200, which isn't there, and has fewer turns than it gives up
    c = next(c for c in range(201, 300) if crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 1, "user", "only")]
    want = [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert _run(spark, rows) == want == _brute(rows)


def test_group_of_copies_and_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(c, t, "user", f"text {t}") for c in range(1, 90) for t in range(3)]
    rows += [(c, 3, "user", f"own {c}") for c in range(1, 60)]
    assert _run(spark, rows, False) == _brute(rows, False)


def test_long_conversation_and_text(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (1, 2) for t in range(3000)] + [(2, 3000, "user", "x" * 3_000_000)]
    got = {r[:2]: r for r in _run(spark, rows, False)}
    assert len(got) == 3002 and got[1, 0][3:7] == (2, 1, 1, 3000) and got[2, 3000 + 1][2:7] == (1, 1, 0, 1, 0)


def test_empty_table(spark):
    assert _run(spark, []) == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = sorted(con.execute(P.OP12_SQL).fetchall(), key=lambda r: (r[0], r[1]))
    got = sorted(map(tuple, P.op12_prefix_trie(spark, "/root/testdata/sf0.01").select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))
    assert got == want and any(r[6] for r in got)
