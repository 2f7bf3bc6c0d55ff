import zlib

import numpy as np
import pandas as pd

from factloom.llm import gru, language_id, toxicity

DOCS = "doc_id long, text string, lang string, score string"


def test_backpropagation_matches_differences():
    pick = np.random.default_rng(1)
    x, u, d = pick.standard_normal((4, 2, 9)), pick.standard_normal((3, 9)), pick.standard_normal((4, 2, 3))
    _, held = gru.forward(x, u)
    dx, du = gru.backward(d, held, u)
    for target, grad in ((x, dx), (u, du)):
        for at in [tuple(pick.integers(n) for n in target.shape) for _ in range(8)]:
            keep, values = target[at], []
            for e in (1e-6, -1e-6):
                target[at] = keep + e
                values.append((gru.forward(x, u)[0] * d).sum())
            target[at] = keep
            assert abs((values[0] - values[1]) / 2e-6 - grad[at]) < 1e-6


def test_scan_matches_forward():
    pick = np.random.default_rng(2)
    table, u = pick.standard_normal((9, 5)).astype(np.float32), pick.standard_normal((3, 9)).astype(np.float32)
    codes = pick.integers(0, 5, (6, 4))
    states, _ = gru.forward(table.T[codes], u)
    for t, made in gru.scan(*gru.prepared(table, u), codes, np.eye(3, dtype=np.float32)):
        assert np.allclose(made.T, states[t], atol=1e-5)


def test_windows_do_not_change_language_probabilities():
    model = language_id.train(["the of and is " * 20, "der die und das " * 20] * 5, ["en", "de"] * 5, steps=40)
    text = b"the and of der und " * 60
    whole = language_id.probabilities([text], model)
    several = language_id.probabilities([b"", text, b"x", text], model)
    assert np.allclose(whole[0], several[1]) and np.allclose(several[1], several[3]) and not several[0].any()
    assert abs(whole.sum() - 1) < 1e-5


def test_language_query_on_held_out_documents(spark):
    out = language_id.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "en", "x"), (2, "", None, None), (3, "12 .. 3", "en", ""), (4, "the the", "en", ""), (None, "the", "en", "")], DOCS
    )
    model = language_id.fit(df)
    out = {r.doc_id: (r.lang_pred, r.score > 0) for r in language_id.predict(df, model).collect()}
    assert out == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True), None: ("en", True)}
    empty = spark.createDataFrame([], DOCS)
    assert language_id.fit(empty) is None and language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if out[r.doc_id].held_out]
    toxic = [out[r.doc_id].predicted for r in labels if r.toxic]
    clean = [out[r.doc_id].predicted for r in labels if not r.toxic]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02  # a tenth of the labels is wrong
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())


def test_toxicity_of_odd_rows(spark):
    texts = ["you vile vile thing of the house", "a fine house of the thing"]
    rows = [(i, texts[i % 2] + f" {i}", "en", "") for i in range(60)] + [(98, None, "", ""), (99, "", "", ""), (None, "x " * 50_000, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert out[98] == out[99] == 0 and min(out[0], out[2]) > max(out[1], out[3])
    assert toxicity.fit(docs, labels.filter("toxic = 1")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_all_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        doc, first = toxicity.windows(np.array([n]))
        covered = {i for f in first for i in range(f, f + toxicity.WINDOW)}
        assert set(range(n)) <= covered and (first < max(n, 1)).all() and len(doc) == len(first)


def _cell(x, h, u):
    """One step of the recurrence, by its definition."""
    k = len(h)
    a = h @ u
    z, r = (1 / (1 + np.exp(-(x[i : i + k] + a[i : i + k]))) for i in (0, k))
    n = np.tanh(x[2 * k :] + r * a[2 * k :])
    return n + z * (h - n)


def _states(rows, u):
    h, out = np.zeros(len(u)), []
    for x in rows:
        h = _cell(x, h, u)
        out.append(h)
    return out


def test_languages_are_those_of_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.learned_rows(docs.doc_id, 4, 2)))
    p = {k: np.array(v, float) for k, v in model.items() if k != "names"}
    out = {r.doc_id: r for r in language_id.op4_language_id(spark, "/root/testdata/sf0.001").collect()}
    blank, around, core = b" ", language_id.CONTEXT, language_id.CORE
    for r in docs.limit(25).collect():
        data, total = r.text.encode(), np.zeros(len(model["names"]))
        for lo in range(0, len(data), core):
            before = data[max(0, lo - around) : lo].rjust(around, blank)
            read = (before + data[lo : lo + core + around]).ljust(core + 2 * around, blank)
            ahead = _states([p["xf"][b] for b in read], p["uf"])
            back = _states([p["xb"][b] for b in reversed(read)], p["ub"])[::-1]
            for i in range(around, around + min(core, len(data) - lo)):
                e = np.exp(np.concatenate([ahead[i], back[i]]) @ p["w"] + p["b"])
                total += e / e.sum()
        total /= max(1, len(data))
        if not any(map(str.isalpha, r.text)):
            assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == ("und", 0.0)
            continue
        assert abs(out[r.doc_id].score - total.max()) < 1e-4
        assert out[r.doc_id].lang_pred == model["names"][total.argmax()] or np.sort(total)[-2] > total.max() - 1e-4


def test_letters():
    for text in ("10\xb2 = 100", "\xbd + \xbd", "\u2167.", "\u2460", "_1_", "", "\u0301"):
        assert not language_id.has_letter(text)
    for text in ("a", "1 \xe9", "\u65e5", "\xb2x", "\xaa", "\u01c5"):
        assert language_id.has_letter(text)


def _plain_score(text, model):
    """A document's score by loops over windows, words and n-grams."""
    p, full = {k: np.array(v, float) for k, v in model["p"].items()}, 2**64
    words, best = text.lower().split(), 0.0

    def inputs(word):
        w = word.strip(toxicity.ENDS)
        data, grams = f"<{w}>".encode(), []
        for n in toxicity.GRAMS:
            for i in range(len(data) - n + 1):
                h = data[i] + 1
                for b in data[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + b + 1) % full
                x = (h + n) % full
                x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % full
                grams.append((x ^ (x >> 32)) % toxicity.BUCKETS)
        own = int(pd.util.hash_array(np.array([w], object), categorize=False)[0]) % toxicity.BUCKETS
        odds = [float(model["odds"].tables[1][g]) for g in grams]
        char = np.mean([p["char"][g] for g in grams], 0) if grams else np.zeros(toxicity.EMBED)
        return np.concatenate([[model["odds"].tables[0][own], max(odds, default=0), np.mean(odds) if odds else 0], p["word"][own], char])

    for lo in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        x = [inputs(w) for w in words[lo : lo + toxicity.WINDOW]]
        if not x:
            continue
        ahead = _states([v @ p["xf"] + p["bf"] for v in x], p["uf"])
        back = _states([v @ p["xb"] + p["bb"] for v in x[::-1]], p["ub"])[::-1]
        states = [np.concatenate(s) for s in zip(ahead, back, strict=True)]
        weight = np.exp([float(np.tanh(s @ p["wa"]) @ p["v"][:, 0]) for s in states])
        pooled = sum(w * s for w, s in zip(weight, states, strict=True)) / weight.sum()
        best = max(best, float(1 / (1 + np.exp(-(pooled @ p["wo"][:, 0] + p["bo"][0])))))
    return best


def test_scores_are_those_of_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learned = ~toxicity.learned_rows(docs.doc_id, 3, 1)
    model = toxicity.fit(docs.filter(learned), labels.filter(~toxicity.learned_rows(labels.doc_id, 3, 1)))
    out = {r.doc_id: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    some = docs.collect()
    for r in sorted(some, key=lambda r: len(r.text))[::6][:25]:
        assert abs(out[r.doc_id].score - _plain_score(r.text, model)) < 1e-4
    assert toxicity.fit(docs.limit(0), labels) is None


def test_without_likelihoods_embeddings_are_learned():
    """The network trains on embeddings alone, too; the README says how far that carries."""
    toxic, clean = ("you vile brat get lost", "the vile brat is here"), ("a fine house of the thing", "we went to the lake")
    texts, labels = [f"{x} {i}" for i in range(40) for x in (*toxic, *clean)], [1, 1, 0, 0] * 40
    model = toxicity.train(texts, labels, likelihoods=False)
    assert not any(t.any() for t in model["odds"].tables)
    score = toxicity.scores(["a vile brat", "the fine lake"], model)
    assert score[0] > score[1]
