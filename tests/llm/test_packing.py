import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, ids string"


def _ids(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def _hold(texts, rows, window=2048):
    """Each id in exactly one piece; sequences gapless and, but for the last, full."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    for doc, pieces in by_doc.items():
        ids, at = texts[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(texts)
    for s, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window if s < max(by_sequence) else at <= window
    assert set(by_sequence) == set(range(len(by_sequence)))


def test_query_packs_everything(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    t = Tokenizer.from_file(PATH)
    texts = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in docs}
    _hold(texts, P.op10_packing(spark, "/root/testdata/sf0.001").collect())


def test_words_at_once_are_what_the_tokenizer_makes():
    assert P._words(PATH).direct
    t = Tokenizer.from_file(PATH)
    texts = ["Été, NIÑO!! straße: µ ªº ÿ İstanbul ΣΑΣ é́ e\u0301, it's IT'S, x.y.,! a,b <|endoftext|>, ﬁ ǅ", "the, the THE The) |the the| 12th 1, ,", "don't. l'été,"]
    for x, made in zip(texts, P.encode_texts(texts, PATH), strict=True):
        assert np.frombuffer(made, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_odd_rows(spark):
    texts = [None, "", "a b\x1cc d", "Ünï ́x <|endoftext|> 'll I'm", "word " * 3000, "x", "é" * 700, " 　\x85 a"]
    rows = [(i, x, None if i % 3 == 0 else f"s{i % 2}", "clash") for i, x in enumerate(texts)]
    from pyspark.sql import functions as F

    out = P.pack(spark.createDataFrame(rows, SCHEMA), PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    _hold({i: _ids(x) for i, x in enumerate(texts)}, out)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two", "a", "")] * 3, SCHEMA)
    assert sum(r.length for r in P.pack(df, PATH).collect()) == 9
    assert P.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_mixture_keeps_to_its_proportions():
    totals = {0: 600_000, 1: 300_000, 2: 51_234, 3: 100}
    s = P.Schedule(totals, 256, 2048)
    seen = np.zeros((10_000, 4))
    for q, total in totals.items():
        _, _, length, place = s.pieces(np.array([q]), np.array([0]), np.array([total]))
        np.add.at(seen[:, q], place // 2048, length)
    used = seen[seen.sum(1) > 0]
    assert used.sum() == sum(totals.values()) and (used[:-1].sum(1) == 2048).all()
    target = np.array([t for t in totals.values()]) / sum(totals.values())
    drift = np.abs(np.cumsum(used[:-2], 0) - np.cumsum(used[:-2].sum(1))[:, None] * target)
    assert drift.max() <= 2 * 256 + 100  # deficits are carried, so no queue is ever further off than this


def test_given_weights_hold_until_a_queue_is_empty():
    s = P.Schedule({0: 256 * 100, 1: 256 * 100}, 256, 2048, {0: 3, 1: 1})
    first = s.slot_places(0, np.arange(100)), s.slot_places(1, np.arange(100))
    assert sorted(np.concatenate(first).tolist()) == list(range(200))
    assert (first[0] < 100).sum() == 75


def test_large_totals_do_not_overflow():
    s = P.Schedule({0: 256 * 10**11, 1: 256 * 3 * 10**11}, 256, 2048)
    assert s.slot_places(1, np.array([3 * 10**11 - 1])).tolist() == [4 * 10**11 - 1]


def test_more_sources_than_one_task_holds(spark, monkeypatch):
    rows = [(i, "word " * (37 * (i % 5) + (3000 if i == 4 else 0)), f"s{i % 7}" if i % 8 else None, "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = {i: _ids(x) for i, x, *_ in rows}
    monkeypatch.setattr(P, "MAX_QUEUES", 2)
    many = P.pack(df, PATH, as_crc=True, slot=64, weights={"s1": 5, None: 9}).collect()
    _hold(texts, many)
    monkeypatch.undo()
    few = P.pack(df, PATH, as_crc=True, slot=64, weights={"s1": 5, None: 9}).collect()
    _hold(texts, few)
    # both ways a queue is as far in any window, but for the slot that ties may give another queue
    source = {i: s for i, _, s, _ in rows}
    def shares(rows):
        out = defaultdict(int)
        for r in rows:
            out[r.sequence_id, source[r.doc_id]] += r.length
        return out
    a, b = shares(many), shares(few)
    assert all(abs(a[k] - b[k]) <= 64 for k in {*a, *b} if k[0] < max(r.sequence_id for r in few) - 1)


def test_long_texts_and_batches_by_bytes(spark):
    from factloom.llm import common

    rows = [(i, "lorem ipsum dolor " * (200_000 if i == 3 else 10), "a", "") for i in range(12)]
    out = P.pack(spark.createDataFrame(rows, SCHEMA), PATH, as_crc=True).collect()
    _hold({i: _ids(x) for i, x, *_ in rows}, out)
    import pyarrow as pa

    batch = pa.record_batch({"a": ["x" * n for n in (1, 3_000_000, 5, 1_500_000, 1_000_000, 2)], "b": [None, "q", "", "r", "s", "t"]})
    parts = list(common.portions(batch))
    assert [p.num_rows for p in parts] == [1, 1, 2, 2] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in common.portions(pa.record_batch({"a": list(range(600))}))] == [256, 256, 88]
    assert list(common.portions(pa.record_batch({"a": pa.array([], pa.string())}))) == []
