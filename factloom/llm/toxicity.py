"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is its lower-cased words between white space. A word's inputs are a hashed word embedding and the sum of
its hashed character n-gram embeddings, both learned, and how much likelier toxic documents hold the word, and
its n-grams, than others. Windows of ``WINDOW`` words, half a window apart, cover the whole text; in each the
network runs both ways, attention pools its states, and a logistic layer scores the pool. The document's score is
its windows' highest.

Training is in numpy by backpropagation through time, on a bounded sample of labelled documents: at most ``TRAIN_ROWS`` of
each label, of at most ``TRAIN_CHARS`` characters each (a stretch of a longer one may lack what its label is for, and
would teach the opposite). All documents are scored whole, whatever their length. Only documents are labelled, so each pass trains on the window that scores highest now in each document, and on random windows
of those that aren't toxic. The counts behind the likelihoods are cross-fitted: a document is trained on with
counts of the other half of the sample.

Defined results: null or empty text, and every text where no label was learned, score 0; texts without words
score 0; very long words count whole; repeated rows score alike; rows with a null id are not learned from;
other columns pass through, but those with an output's name give way; a document whose labels disagree is toxic.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import gru
from factloom.llm.common import extend, table
from factloom.llm.language_id import learned_rows

#: Bounds of the training sample: documents of each label, and the characters that one may have to be in it.
TRAIN_ROWS, TRAIN_CHARS = 1500, 12_000
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, BUCKETS, GRAMS = 12, 4, 1 << 16, (3, 4, 5)
ROUNDS, BATCH, RATE = 5, 64, 0.01
#: Observations that a likelihood needs to leave the prior.
PRIOR = 6.0
THRESHOLD = 0.7
ENDS = ".,;:!?\"'()[]{}<>|*#%$&-_/\\=+~`^"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram, and every word's own bucket. Words lose what isn't part of them at
    their ends, and stand between < and >."""
    words = [w.strip(ENDS) for w in words]
    data = [f"<{w}>".encode() for w in words]
    sizes = np.array([len(x) for x in data])
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(text)) if len(text) else np.zeros(0, int)
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        rolled = text + np.uint64(1)
        for n in range(2, max(GRAMS) + 1):
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + text[n - 1 :] + np.uint64(1) if len(rolled) else rolled
            if n in GRAMS:
                whole = np.flatnonzero(left[: len(rolled)] >= n)
                owners.append(word[whole])
                buckets.append(_mix(rolled[whole] + np.uint64(n)) % np.uint64(BUCKETS))
        own = pd.util.hash_array(np.array(words, object), categorize=False) % np.uint64(BUCKETS) if words else np.zeros(0)
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order].astype(np.int32), bucket[order].astype(np.int32), own.astype(np.int64)


class Likelihoods:
    """Log-odds of toxic documents, by bucket of words and of n-grams."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        """docs: the distinct word buckets and n-gram buckets of each."""
        toxic = max(1.0, labels.sum())
        share = toxic / max(2.0, len(labels))
        self.tables = []
        for part in (0, 1):
            seen = np.zeros((2, BUCKETS), np.float32)
            for doc, label in zip(docs, labels, strict=True):
                seen[int(label), doc[part]] += 1
            odds = np.log((seen[1] + PRIOR * share) / (seen[0] + PRIOR * (1 - share))) - np.log(share / (1 - share))
            self.tables.append(odds.astype(np.float32))


class NoLikelihoods:
    """In place of likelihoods, so that a test can tell what the embeddings alone make of a text."""

    tables = [np.zeros(BUCKETS, np.float32)] * 2


def features(grams: tuple, odds: Likelihoods | type[NoLikelihoods], p: gru.Params) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of every word: its odds, its n-grams' highest and mean odds, embeddings; and its n-grams' number."""
    owner, bucket, own = grams
    count = np.bincount(owner, minlength=len(own)).astype(np.float32)
    out = np.zeros((len(own), 3 + 2 * EMBED), np.float32)
    if not len(own):
        return out, count
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    has = owner[heads]
    value = odds.tables[1][bucket]
    out[:, 0] = odds.tables[0][own]
    out[has, 1] = np.maximum.reduceat(value, heads)
    out[has, 2] = np.add.reduceat(value, heads) / count[has]
    out[:, 3 : 3 + EMBED] = p["word"][own]
    out[has, 3 + EMBED :] = np.add.reduceat(p["char"][bucket], heads, axis=0) / count[has, None]
    return out, count


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of all windows over documents of so many words, half a window apart."""
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def _codes(flat: np.ndarray, begin: np.ndarray, left: np.ndarray, blank: int) -> np.ndarray:
    """(WINDOW, windows) words; ``blank`` beyond the text."""
    at = np.arange(WINDOW)[:, None]
    return np.where(at < left[None, :], flat[np.minimum(begin[None, :] + at, max(0, len(flat) - 1))], blank)


def score_windows(inputs: np.ndarray, codes: np.ndarray, p: gru.Params) -> np.ndarray:
    """Probabilities of windows; the last row of ``inputs`` is the blank, at which states stay and nothing pools."""
    live = codes != len(inputs) - 1
    out, eye = np.empty(codes.shape[1]), np.eye(HIDDEN, dtype=np.float32)
    ahead, back = gru.prepared((inputs @ p["xf"] + p["bf"]).T, p["uf"]), gru.prepared((inputs @ p["xb"] + p["bb"]).T, p["ub"])
    for lo in range(0, codes.shape[1], 4096):
        part, on = codes[:, lo : lo + 4096], live[:, lo : lo + 4096]
        states = np.empty((len(part), 2 * HIDDEN, part.shape[1]), np.float32)
        for t, h in gru.scan(*ahead, part, eye, on):
            states[t, :HIDDEN] = h
        for t, h in gru.scan(*back, part[::-1], eye, on[::-1]):
            states[len(part) - 1 - t, HIDDEN:] = h
        weight = np.einsum("a,tab->tb", p["v"][:, 0], np.tanh(np.matmul(p["wa"].T, states)))
        weight = np.where(on, weight, -1e30)
        weight = np.exp(weight - weight.max(0)) * on
        pooled = np.einsum("tb,thb->hb", weight, states) / np.maximum(weight.sum(0), 1e-30)
        out[lo : lo + 4096] = gru.sigmoid(p["wo"][:, 0] @ pooled + p["bo"][0])
    return out


def _init(seed: int) -> gru.Params:
    pick, wide = np.random.default_rng(seed), 3 + 2 * EMBED
    draw = lambda *shape: (pick.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {k: draw(wide, 3 * HIDDEN) for k in ("xf", "xb")} | {k: draw(HIDDEN, 3 * HIDDEN) for k in ("uf", "ub")}
    p |= {k: np.zeros(3 * HIDDEN, np.float32) for k in ("bf", "bb")}
    p |= {"wa": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN, 1), "wo": draw(2 * HIDDEN, 1), "bo": np.zeros(1, np.float32)}
    return p | {k: (0.1 * pick.standard_normal((BUCKETS, EMBED))).astype(np.float32) for k in ("word", "char")}


def _train_batch(x: np.ndarray, live: np.ndarray, y: np.ndarray, p: gru.Params) -> tuple[dict, np.ndarray]:
    """Gradients by backpropagation through time. x: (time, batch, inputs), live: (time, batch)."""
    x = x * live[:, :, None]
    hf, cf = gru.forward(x @ p["xf"] + p["bf"], p["uf"])
    order = np.argsort(~live[::-1], axis=0, kind="stable")  # backward, from each window's last word
    back = np.take_along_axis(x[::-1], order[:, :, None], 0)
    hb, cb = gru.forward(back @ p["xb"] + p["bb"], p["ub"])
    home = np.argsort(order, axis=0)
    states = np.concatenate([hf, np.take_along_axis(hb, home[:, :, None], 0)[::-1]], 2)
    tanh = np.tanh(states @ p["wa"])
    weight = np.where(live, (tanh @ p["v"])[:, :, 0], -1e30)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    d = (gru.sigmoid((pooled @ p["wo"])[:, 0] + p["bo"][0]) - y)[:, None] / len(y)
    d_pool = d @ p["wo"].T
    d_weight = np.einsum("bh,tbh->tb", d_pool, states)
    d_weight = weight * (d_weight - (weight * d_weight).sum(0))
    d_tanh = d_weight[:, :, None] * p["v"][:, 0] * (1 - tanh**2)
    d_states = weight[:, :, None] * d_pool + d_tanh @ p["wa"].T
    grads = {"wo": pooled.T @ d, "bo": d.sum(0), "v": np.einsum("tbh,tb->h", tanh, d_weight)[:, None],
             "wa": np.einsum("tbi,tbj->ij", states, d_tanh)}
    dxf, grads["uf"] = gru.backward(d_states[:, :, :HIDDEN], cf, p["uf"])
    d_back = np.take_along_axis(d_states[::-1, :, HIDDEN:], order[:, :, None], 0)
    dxb, grads["ub"] = gru.backward(d_back, cb, p["ub"])
    grads |= {"xf": np.einsum("tbi,tbj->ij", x, dxf), "bf": dxf.sum((0, 1))}
    grads |= {"xb": np.einsum("tbi,tbj->ij", back, dxb), "bb": dxb.sum((0, 1))}
    d_in = np.take_along_axis(dxb @ p["xb"].T, home[:, :, None], 0)[::-1] + dxf @ p["xf"].T
    return grads, d_in * live[:, :, None]


def train(texts: list[str], labels: list[int], seed: int = 11, likelihoods: bool = True) -> dict | None:
    """The network and its likelihoods; None unless both labels occur. Without likelihoods, embeddings are all inputs."""
    y = np.array([int(x) for x in labels])
    if len(set(y.tolist())) < 2:
        return None
    pick, p = np.random.default_rng(seed), _init(seed)
    docs = [x.lower().split() for x in texts]
    sizes = np.array([len(x) for x in docs])
    count = len(docs)
    flat, words = pd.factorize(np.array([w for x in docs for w in x], object))
    del docs, texts  # millions of strings
    grams = gram_buckets(list(words))
    owner, bucket, own = grams
    spans = np.searchsorted(owner, np.arange(len(own) + 1))
    begin = np.cumsum(sizes) - sizes
    held = []
    for b, n in zip(begin, sizes, strict=True):
        distinct = np.unique(flat[b : b + n])
        mine = [bucket[spans[w] : spans[w + 1]] for w in distinct]
        held.append((np.unique(own[distinct]), np.unique(np.concatenate(mine)) if mine else np.zeros(0, int)))
    half = pick.integers(0, 2, count)
    odds = [Likelihoods([held[i] for i in np.flatnonzero(half != k)], y[half != k]) if likelihoods else NoLikelihoods for k in (0, 1)]
    doc, first = windows(sizes)
    codes = _codes(flat, begin[doc] + first, sizes[doc] - first, len(words))
    dense = {k: v for k, v in p.items() if k not in ("word", "char")}
    adam = gru.Adam(dense, RATE)
    for turn in range(ROUNDS):
        score = np.zeros(len(doc))
        inputs = [np.vstack([features(grams, odds[k], p)[0], np.zeros((1, 3 + 2 * EMBED), np.float32)]) for k in (0, 1)]
        for k in (0, 1):
            mine = half[doc] == k
            if turn:
                score[mine] = score_windows(inputs[k], codes[:, mine], p)
            else:  # at first, by the likeliest word
                score[mine] = inputs[k][:, 1][codes[:, mine]].max(0)
        order = np.lexsort([-score, doc])
        best = order[np.diff(doc[order], prepend=-1) > 0]
        more = pick.permutation(np.flatnonzero(y[doc] == 0))[: 2 * len(best)]
        chosen = pick.permutation(np.concatenate([best, best[y[doc[best]] == 1], more]))
        adam.rate = RATE * (1 - 0.8 * turn / ROUNDS)
        for lo in range(0, len(chosen), BATCH):
            at = chosen[lo : lo + BATCH]
            part = codes[:, at]
            live = part != len(words)
            side = half[doc[at]]
            x = np.where(side[None, :, None] == 0, inputs[0][part], inputs[1][part])
            x[:, :, 3 : 3 + EMBED] = np.where(live[:, :, None], p["word"][own[np.minimum(part, len(words) - 1)]], 0)
            grads, d_in = _train_batch(x, live, y[doc[at]], p)
            adam.step(grads)
            used = part[live]
            rate = 3 * adam.rate  # the tables learn by plain gradients, only where they were read
            np.add.at(p["word"], own[used], -rate * d_in[live][:, 3 : 3 + EMBED])
            size = spans[used + 1] - spans[used]
            word = np.repeat(np.arange(len(used)), size)
            near = bucket[np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + spans[used][word]]
            step = (-rate * d_in[live][:, 3 + EMBED :] / np.maximum(size, 1)[:, None])[word]
            for c in range(EMBED):
                p["char"][:, c] += np.bincount(near, step[:, c], BUCKETS).astype(np.float32)
    return {"p": p, "odds": Likelihoods(held, y) if likelihoods else NoLikelihoods}


def scores(texts: list[str], model: dict | None) -> np.ndarray:
    out = np.zeros(len(texts))
    docs = [x.lower().split() if model else [] for x in texts]
    sizes = np.array([len(x) for x in docs], int)
    if not sizes.sum():
        return out
    flat, words = pd.factorize(np.array([w for x in docs for w in x], object))
    inputs = np.vstack([features(gram_buckets(list(words)), model["odds"], model["p"])[0], np.zeros((1, 3 + 2 * EMBED), np.float32)])
    doc, first = windows(sizes)
    begin = np.cumsum(sizes) - sizes
    for lo in range(0, len(doc), 16_384):
        part = slice(lo, lo + 16_384)
        codes = _codes(flat, begin[doc[part]] + first[part], sizes[doc[part]] - first[part], len(words))
        np.maximum.at(out, doc[part], score_windows(inputs, codes, model["p"]))
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """Trains on documents that have a label; the first of each label by a hash of their id."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(f"length(t) BETWEEN 1 AND {TRAIN_CHARS}")
    sample = []
    for y in (0, 1):
        # ids first: the texts of the chosen alone are read
        of_label = known.filter(F.col("y") == y)
        share = min(1.0, 3 * TRAIN_ROWS / max(1, of_label.count()))  # each task sends its share of the sample only
        of_label = of_label.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
        ids = of_label.join(rows.select("k"), "k").orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
        chosen = [r.k for r in ids.select("k").collect()]
        found = rows.filter(F.col("k").isin(chosen)).orderBy("k", "t").limit(2 * TRAIN_ROWS).collect() if chosen else []
        sample += [(r.t, y) for r in found]
    return train([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: dict | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the text is left out on demand. The model goes to the executors as a broadcast of a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        made = scores([x or "" for x in batch.column(text).to_pylist()], shared.value)
        return {"score": made, "predicted": (made >= THRESHOLD).astype(np.int32)}

    return extend(docs, "score double, predicted int", run, () if keep_text else (text,))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = learned_rows(F.col("doc_id"), 3, 1)
    model = fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")
