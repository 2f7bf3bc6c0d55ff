import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

from factloom.llm import bpe_transducer as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string"
ODD = ["", " ", "a" * 3000, " \n\t  x", "é日本語🤗 'll don't 123456 !!!??", "̀́ à", "the the the", "a  b \n c\x1cd \x1e e \u3000f\u00a0 g ", " lead", "a 's b", None, "the the the"]


def _library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def test_matches_the_library(spark):
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in B.decode(B.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()}
    library = _library()
    for i, text in enumerate(texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == library.encode_ordinary(text or "")
        assert rows[i].decoded == (text or "")


def test_pair_rule_matches_merging():
    ranks = B.read_ranks(PATH)
    t = B.Transducer(ranks)
    pick = random.Random(3)
    ids = [i for i in t.tokens if t._edges(i)]
    for _ in range(3000):
        a, b = pick.choice(ids), pick.choice(ids)
        assert t._follows(a, b) == (B.merge_by_rank(t.tokens[a] + t.tokens[b], ranks) == [t.tokens[a], t.tokens[b]])


def test_states_are_bounded():
    t = B.Transducer(B.read_ranks(PATH), max_states=50)
    for word in (f"w{i}xyz" for i in range(300)):
        assert [t.tokens[i] for i in t.encode(word.encode())] == B.merge_by_rank(word.encode(), t.ranks)
    assert len(t.states) < 200


def test_streaming_decode_at_any_cut():
    text = "aé日本🤗z" * 3
    data = text.encode() + b"\xff" + b"\xe6\x97"
    for cut in range(len(data)):
        m = B.Utf8Machine()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.close() == data.decode(errors="replace")


def test_query_and_empty_table(spark):
    df = B.op6_bpe_transducer(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library = _library()
    for r in df.collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert B.encode(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).count() == 0
