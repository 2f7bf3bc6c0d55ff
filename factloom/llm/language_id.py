"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

The network gives every byte position probabilities over the languages; a document's are their mean. It is
trained in numpy by backpropagation through time on one stretch of each of at most ``TRAIN_ROWS`` labelled
documents, the first by a hash of their id. Whole texts are scored: windows of ``CORE`` bytes side by side, each
read with ``CONTEXT`` more bytes before and behind it so that no position is labelled without surroundings.

Defined results: null text and text without a letter are ``und`` with score 0; without any labelled document all
are ``und``; ties go to the language that sorts first; repeated rows get the same result; rows with a null id
are never learned from; other columns pass through, but those with an output's name give way.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import gru
from factloom.llm.common import extend, table

#: Bounds of the training sample: labelled documents, and characters of the stretch that is taken from each.
TRAIN_ROWS, STRETCH = 4000, 400
HIDDEN, STEPS, BATCH, LENGTH = 10, 700, 128, 48
CORE, CONTEXT = 240, 16
#: Marks and digits of other scripts stand among word characters; ``has_letter`` looks at these more closely.
WORDY = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character of any script's letters (Unicode's L categories) is in ``text``; superscripts, fractions and numerals
    that are word characters are none."""
    return any(run.isascii() or any(map(str.isalpha, run)) for run in map(operator.itemgetter(0), WORDY.finditer(text)))


def train(texts: list[str], labels: list[str], seed: int = 7, steps: int = STEPS) -> dict | None:
    """The network: byte tables and recurrent matrices of both directions, and the positions' output layer."""
    names = sorted(set(labels))
    if not names:
        return None
    pick = np.random.default_rng(seed)
    by_class = [[] for _ in names]
    for text, label in zip(texts, labels, strict=True):
        if len(data := np.frombuffer(text.encode(), np.uint8)) >= 4:
            by_class[names.index(label)].append(data)
    classes = [c for c, held in enumerate(by_class) if held]
    init = lambda *shape: (pick.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {k: init(HIDDEN, 3 * HIDDEN) for k in ("uf", "ub")} | {k: init(256, 3 * HIDDEN) * 4 for k in ("xf", "xb")}
    p |= {"w": init(2 * HIDDEN, len(names)), "b": np.zeros(len(names), np.float32)}
    adam = gru.Adam(p, 0.01)
    for step in range(steps if classes else 0):
        adam.rate = 0.01 * (1 - 0.9 * step / steps)
        target = pick.choice(classes, BATCH)
        codes = np.zeros((LENGTH, BATCH), np.int64)
        for j, c in enumerate(target):
            data = by_class[c][pick.integers(len(by_class[c]))]
            at = pick.integers(max(1, len(data) - LENGTH + 1))
            part = data[at : at + LENGTH]
            codes[: len(part), j] = part
            if len(part) < LENGTH:  # short texts follow themselves
                codes[:, j] = np.resize(part, LENGTH)
        hf, cf = gru.forward(p["xf"][codes], p["uf"])
        hb, cb = gru.forward(p["xb"][codes[::-1]], p["ub"])
        h = np.concatenate([hf, hb[::-1]], 2)
        logits = h @ p["w"] + p["b"]
        d = np.exp(logits - logits.max(2, keepdims=True))
        d /= d.sum(2, keepdims=True)
        d[:, np.arange(BATCH), target] -= 1
        d /= LENGTH * BATCH
        dh = d @ p["w"].T
        grads = {"w": np.einsum("tbh,tbc->hc", h, d), "b": d.sum((0, 1))}
        for x, u, held, dstate, read in (
            ("xf", "uf", cf, dh[:, :, :HIDDEN], codes), ("xb", "ub", cb, dh[::-1, :, HIDDEN:], codes[::-1]),
        ):
            dx, grads[u] = gru.backward(dstate, held, p[u])
            one_hot = np.zeros((256, 3 * HIDDEN), np.float32)
            np.add.at(one_hot, read.ravel(), dx.reshape(-1, 3 * HIDDEN))
            grads[x] = one_hot
        adam.step(grads)
    return p | {"names": names}


def probabilities(texts: list[bytes], model: dict) -> np.ndarray:
    """(texts, languages): the mean over each text's positions; zeros for an empty text."""
    sizes = np.array([len(x) for x in texts])
    count = -(-sizes // CORE)
    out = np.zeros((len(texts), len(model["names"])))
    if not count.sum():
        return out
    data = np.frombuffer(b" " * CONTEXT + (b" " * CONTEXT).join(texts) + b" " * (CORE + 2 * CONTEXT), np.uint8)
    begin = np.cumsum(np.concatenate([[0], sizes[:-1] + CONTEXT])) if len(sizes) else np.zeros(0, int)  # of the context
    doc = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[doc] + nth * CORE
    filled = np.minimum(CORE, sizes[doc] - nth * CORE)
    total = np.zeros((len(doc), out.shape[1]))
    ahead, back = gru.prepared(model["xf"].T, model["uf"]), gru.prepared(model["xb"].T, model["ub"])
    for lo in range(0, len(doc), 4096):
        part = slice(lo, lo + 4096)
        codes = data[at[part][None, :] + np.arange(CORE + 2 * CONTEXT)[:, None]].astype(np.intp)
        codes[np.arange(len(codes))[:, None] >= CONTEXT + (sizes[doc] - nth * CORE)[part]] = 32  # no other text of the batch
        logits = np.empty((CORE, out.shape[1], codes.shape[1]), np.float32)
        steps = len(codes)
        for t, made in gru.scan(*ahead, codes[: CONTEXT + CORE], model["w"][:HIDDEN].T):
            if t >= CONTEXT:
                logits[t - CONTEXT] = made
        for t, made in gru.scan(*back, codes[: CONTEXT - 1 : -1], model["w"][HIDDEN:].T):
            if CONTEXT <= t:
                logits[steps - 1 - t - CONTEXT] += made
        logits += model["b"][:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        logits *= (np.arange(CORE)[:, None] < filled[part])[:, None, :]
        total[part] = logits.sum(0).T
    np.add.at(out, doc, total)
    return out / np.maximum(sizes, 1)[:, None]


def learned_rows(key: Column, modulus: int, held: int) -> Column:
    """True where the crc32 of the id as text leaves the held-out remainder; null ids aren't held out."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == held, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """Trains on the rows of ``docs`` that have id, text and language; a bounded, hash-ordered sample of them."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    rows = rows.filter("k IS NOT NULL AND length(t) > 0 AND l IS NOT NULL")
    # by the hash first, so that each task sends the driver its share of the sample only
    share = min(1.0, 1.5 * TRAIN_ROWS / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    stretch = F.expr(f"substr(t, 1 + cast(pmod(xxhash64(k, 1), greatest(1, length(t) - {STRETCH} + 1)) as int), {STRETCH})")
    sample = rows.select(F.xxhash64("k").alias("h"), stretch.alias("t"), "l").orderBy("h", "t", "l").limit(TRAIN_ROWS)
    found = sample.collect()
    return train([r.t for r in found], [r.l for r in found])


def predict(docs: DataFrame, model: dict | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the text is left out on demand."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text).to_pylist()
        known = [x if model and x and has_letter(x) else "" for x in texts]
        if not model:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        found = probabilities([x.encode() for x in known], model)
        best = found.argmax(1)
        return {
            "lang_pred": [model["names"][b] if x else "und" for b, x in zip(best, known, strict=True)],
            "score": np.clip(found[np.arange(len(best)), best], 0, 1),
        }

    return extend(docs, "lang_pred string, score double", run, () if keep_text else (text,))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = learned_rows(F.col("doc_id"), 4, 2)
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
