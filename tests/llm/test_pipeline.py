import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, spans string"


def _docs(spark):
    pick = random.Random(4)
    en, de = "the and of that with this from they".split(), "der und das nicht mit sich eine auch".split()
    say = lambda words, n: " ".join(pick.choice(words) + pick.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(60):
        words = de if i % 3 == 0 else en
        rows.append((i, "\n".join(say(words, 12) for _ in range(3)), "de" if i % 3 == 0 else "en"))
    long = say(en, 70)
    rows += [(100, f"start here {say(en, 9)}\n{long}", "en"), (101, f"another one {say(en, 9)}\n{long}\nafter that", "en"), (102, long, "en")]
    near = say(en, 90).split()
    rows += [(110, " ".join(near), "en"), (111, " ".join(near[:-1] + ["x"]), "en"), (111, " ".join(near[:-1] + ["x"]), "en")]
    rows += [(120, f"{say(en, 15)} mail a.b@c.example.com or +1 (269) 555-3296 4524132264652876", "en"), (130, None, "en"), (131, "", "en"), (132, "12 ..", None)]
    return spark.createDataFrame([(k, t, g, f"s{k % 3}", len(t or ""), "own", 7, "mine") for k, t, g in rows], SCHEMA)


def test_stages_against_their_definitions(spark):
    docs, states = _docs(spark), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        states.append({r.doc_id: r for r in out.collect()} if stage is not corpus_pipeline.STAGES[-1][1] else out.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), out.schema)
    language, lines, near, private, packed = states
    assert {130, 131, 132}.isdisjoint(language) and len(language) >= 64
    assert 102 not in lines and lines[100].text == language[100].text
    assert lines[101].text == "\n".join(language[101].text.split("\n")[::2]) and lines[101].n_chars == len(lines[101].text)
    assert set(lines) - set(near) == {111} and all((r.score, r.n_lines, r.spans) == ("own", 7, "mine") for r in private.values())
    assert private[120].text.endswith("mail <EMAIL> or <PHONE> <CARD>") and private[120].n_chars == len(private[120].text)
    assert all(private[k].text == near[k].text for k in near if k != 120)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for key, r in private.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted((p for p in packed if p.doc_id == key), key=lambda p: p.start)])
        assert ids.tolist() == [*t.encode(r.text, add_special_tokens=False).ids, 1]


def test_empty_table(spark):
    docs = _docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_repeated_rows_and_nulls_in_every_column(spark):
    rows = [(None,) * 8, (1, "only these few words here now", None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, None), (1, "only these few words here now")]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {r.sequence_id for r in rows} == set(range(max(r.sequence_id for r in rows) + 1))


def test_a_very_long_text_and_ties(spark):
    """Copies of one text under several ids: the least id stays; a long text goes through whole."""
    pick = random.Random(9)
    say = lambda n: " ".join(pick.choice("the and of that with this from they".split()) + pick.choice("abcdefghij") for _ in range(n))
    long, tie = "\n".join(say(12) for _ in range(6000)), say(30)
    rows = [(5, long), (9, tie), (7, tie), (8, tie), (7, tie), (30, say(40))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), "own", 7, "mine") for k, t in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        if name == "line dedup":
            assert docs.count() == 6  # thirty words are no run
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted([(5, long), (7, tie), (30, rows[-1][1])])
