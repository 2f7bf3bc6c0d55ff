"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction put together of one random unit vector for each block of the (randomly rotated) coordinates,
a product code, so that a few codewords a block give very many filters. A vector passes the filters whose direction
it exceeds the threshold with; list decoding finds them from the blocks' sorted products without trying each. Vectors
that pass a common filter are compared in double precision. Threshold and number of filters follow from the
number of vectors (a filter passes about ``BUCKET`` of them) and from measuring how often a random pair at the
least cosine passes a random filter together: ``SHARED`` filters are expected to hold such a pair, and more if fewer
than ``RECALL`` of such pairs then share one.

Equal vectors are one class. Filters are joined on twice. First only ids travel, each with a sketch of 128 bits (the
signs of random directions): of a pair at the least cosine more than ``far`` bits differ with a chance below 1e-6. What has no
partner within that in a filter leaves it, which is nearly all; for the rest, vectors and the filters where they stayed travel, and
cosines decide. A pair that shares several filters counts at the first. A filter that passes more than ``CHUNK`` classes is
cut into chunks, and each pair of chunks is a group of its own, so no group is larger. Lengths that fewer than ``CHUNK`` vectors
have, or that aren't among the ``LENGTHS`` most frequent, get no filters: all of a length's vectors meet in such chunks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and are
their own component; so are rows with a null id, whose component is null and which aren't kept; vectors of different
lengths don't link; rows with equal vectors link, rows with one id too; other columns pass through, but those
with an output's name give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_batches, map_whole, table, written
from factloom.llm.components import components

COSINE = 0.9
BUCKET, SHARED, CODES, CHUNK, SEED = 150, 8.0, 16, 1024, 17
#: Lengths that get filters, at most; bits of a sketch.
LENGTHS, BITS = 32, 128
#: More words are drawn until so many of ``PAIRS`` random pairs at the least cosine share a filter.
RECALL, PAIRS = 0.97, 1000


def _pairs(pick: np.random.Generator, count: int, length: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and others at that cosine to them."""
    x, y = pick.standard_normal((2, count, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if length > 1:
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * y * (length > 1)


class Filters:
    """Product codes for vectors of one length, each behind a rotation of its own."""

    def __init__(self, length: int, vectors: int, cosine: float, seed: int = SEED):
        pick = np.random.default_rng([seed, length])
        self.blocks = 3 if length >= 12 else 1
        self.cuts = np.linspace(0, length, self.blocks + 1).astype(int)
        tried = np.hstack([self._words(pick, 4000, b - a) for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
        x, y = _pairs(pick, 300, length, cosine)
        one, two = x @ tried.T, y @ tried.T
        wanted = min(0.05, BUCKET / max(1, vectors))
        measured = max(wanted, 2e-3)
        while True:  # caps of few dimensions must be wide enough to hold such a pair at all
            self.threshold = float(np.quantile(one, 1 - measured))
            together = float(((one >= self.threshold) & (two >= self.threshold)).mean())
            if together >= 0.25 * measured or measured >= 0.5:
                break
            measured = min(0.5, 1.5 * measured)
        if wanted < measured and length >= 12:  # too rare for single words: measured on whole product codes
            together = self._rare(pick, x, y, wanted, measured)
        self.words = max(2, math.ceil((SHARED / CODES / max(together, 1e-12)) ** (1 / self.blocks)))
        self.codes = self._drawn(pick, length)
        if self.blocks > 1:  # pairs share words, so the expected number of filters doesn't tell recall
            x, y = _pairs(pick, PAIRS, length, cosine)
            while np.mean(self._shared(x, y) > 0) < RECALL:
                self.words = math.ceil(1.06 * self.words)
                self.codes = self._drawn(pick, length)

    def _rare(self, pick: np.random.Generator, x: np.ndarray, y: np.ndarray, wanted: float, measured: float) -> float:
        """Sets the threshold that ``wanted`` of random vectors exceed; how often a pair does so together."""
        length = x.shape[1]
        self.words = math.ceil((60 / CODES / wanted) ** (1 / self.blocks))  # about 60 filters a vector
        self.codes = self._drawn(pick, length)
        number, normal = CODES * self.words**self.blocks, NormalDist()
        low = self.threshold
        high = 1.1 * low * normal.inv_cdf(1 - wanted) / normal.inv_cdf(1 - measured)  # above it, as blocks have lighter tails
        for _ in range(12):
            self.threshold = (low + high) / 2
            if sum(len(self.passed(v)) for v in x) > wanted * number * len(x):
                low = self.threshold
            else:
                high = self.threshold
        return float(self._shared(x, y).mean()) / number

    def _shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of filters that each pair passes together."""
        return np.array([len(np.intersect1d(self.passed(a), self.passed(b), assume_unique=True)) for a, b in zip(x, y, strict=True)])

    def _drawn(self, pick: np.random.Generator, length: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        codes = []
        for _ in range(CODES):
            rotation = np.linalg.qr(pick.standard_normal((length, length)))[0]
            codes.append((rotation, [self._words(pick, self.words, b - a) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]))
        return codes

    def _words(self, pick: np.random.Generator, count: int, length: int) -> np.ndarray:
        words = pick.standard_normal((count, length))
        return words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(self.blocks)

    def passed(self, unit: np.ndarray) -> np.ndarray:
        """Ids of all filters that a unit vector exceeds, ascending."""
        return np.concatenate([c * self.words**self.blocks + self._decoded(unit, *code) for c, code in enumerate(self.codes)])

    def _decoded(self, unit: np.ndarray, rotation: np.ndarray, code: list[np.ndarray]) -> np.ndarray:
        turned = unit @ rotation
        parts = [words @ turned[a:b] for words, a, b in zip(code, self.cuts, self.cuts[1:], strict=False)]
        if self.blocks == 1:
            return np.flatnonzero(parts[0] >= self.threshold)
        order = np.argsort(-parts[2])
        falling = -parts[2][order]  # ascending
        first = np.flatnonzero(parts[0] >= self.threshold - parts[1].max() + falling[0])
        sums = parts[0][first][:, None] + parts[1][None, :]
        i, j = np.nonzero(sums >= self.threshold + falling[0])
        count = np.searchsorted(falling, sums[i, j] - self.threshold, side="right")
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.sort((np.repeat(first[i], count) * self.words + np.repeat(j, count)) * self.words + order[k])


def _units(lists: list) -> np.ndarray:
    return _normed(np.array(lists, np.float64))


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first by a power of two, which rounds nothing, as squares of very large or small components are no doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _joined(links: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of classes, one of which may be the other."""
    ids, place = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
    a, b = place[: len(mine)], place[len(mine) :]
    group, out = np.arange(len(ids)), []
    for i in np.flatnonzero(links.any(1)):
        others = np.flatnonzero(links[i])
        others = others[group[b[others]] != group[a[i]]]
        while len(others):
            out.append((int(mine[i]), int(theirs[others[0]])))
            group[group == group[b[others[0]]]] = group[a[i]]
            others = others[group[b[others]] != group[a[i]]]
    return out


class Sketch:
    """Signs of random directions, for vectors of one length; how many may differ."""

    def __init__(self, length: int, cosine: float, seed: int = SEED):
        self.directions = np.random.default_rng([seed, length, 1]).standard_normal((length, BITS))
        flips = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        self.far = math.ceil(BITS * flips + 5 * math.sqrt(BITS * flips * (1 - flips)))

    def of(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.directions > 0, axis=1).view(np.int64)


@lru_cache(maxsize=64)
def _sketch(length: int, cosine: float) -> Sketch:
    return Sketch(length, cosine)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group of a sorted partition, by its first columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in columns], axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            now = tuple(k[a] for k in columns)
            if held and now != key:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _sides(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of a group's two sides, and whether they are the same chunk."""
    same, side = part.column(1)[0].as_py() == part.column(2)[0].as_py(), part.column(3).to_numpy()
    left = np.flatnonzero(side == 0)
    return left, left if same else np.flatnonzero(side == 1), same


class _Members:
    """A group's rows as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.filter = batch.column(0)[0].as_py()
        self.left, self.right, self.same = _sides(batch)
        self.id, self.copies = (batch.column(i).to_numpy() for i in (4, 5))
        vectors = batch.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(self.id), -1)
        self.unit = _normed(vectors)
        filters = batch.column(7)
        offsets = filters.offsets.to_numpy()
        values, owner = filters.flatten().to_numpy(), np.repeat(np.arange(len(self.id)), np.diff(offsets))
        below = values < self.filter
        self.lower, place = np.unique(values[below], return_inverse=True)
        self.held = np.zeros((len(self.id), len(self.lower)), np.float32)
        self.held[owner[below], place] = 1

    def pairs(self, cosine: float) -> np.ndarray:
        """Links between the chunks' members that no earlier filter holds."""
        found = self.unit[self.left] @ self.unit[self.right].T >= cosine
        if self.same:
            np.fill_diagonal(found, False)
        if found.any() and len(self.lower):
            found &= self.held[self.left] @ self.held[self.right].T < 0.5
        return found


def links(classes: DataFrame, cosine: float, exact: bool = False) -> DataFrame:
    """Written rows (u, v, n): v null: a class links to n vectors of other classes; else a link that joins two classes.

    classes: (id, copies, vector), vectors all different. ``exact``: neither filters nor sketches, all vectors of a length meet."""
    often = classes.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).filter(f"n >= {CHUNK}")
    codes, start, first = {}, {}, 1 << 20  # ids below are those of lengths without filters
    for r in often.orderBy(F.desc("n"), "length").limit(0 if exact else LENGTHS).collect():
        codes[r.length], start[r.length] = Filters(r.length, r.n, cosine), first << 21
        first += CODES * codes[r.length].words ** codes[r.length].blocks >> 21
        first += 1

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"s": [], "t": [], "filters": []}
            for v in batch.column(2).to_pylist():
                unit = _units([v])
                s, t = _sketch(len(v), cosine).of(unit)[0].tolist()
                found = (start[len(v)] + codes[len(v)].passed(unit[0])).tolist() if len(v) in codes else [len(v)]
                for k, x in zip(out, (s, t, found), strict=True):
                    out[k].append(x)
            yield {"id": batch.column(0), "copies": batch.column(1), "vector": batch.column(2), **out}

    vector = classes.schema["vector"].dataType
    base = [T.StructField("id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("vector", vector)]
    schema = T.StructType([*base, T.StructField("s", T.LongType()), T.StructField("t", T.LongType()), T.StructField("filters", T.ArrayType(T.LongType()))])
    held = written(map_batches(classes.select("id", "copies", "vector"), schema, decode), "filters")
    rows = held.select("id", F.size("vector").alias("length"), "s", "t", F.explode("filters").alias("f"))
    crowded = rows.groupBy("f").agg(F.count("*").alias("n")).filter(f"n > {CHUNK}")
    crowded = written(crowded.select("f", F.ceil(F.col("n") / (CHUNK / 2)).cast("int").alias("chunks")), "crowded")

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows (f, a, b, side, ...) of filter f, or of its pair of chunks a, b, together and in order."""
        rows = rows.join(crowded, "f", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(id), chunks) as int)"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        a = F.least("own", "other")
        rows = rows.select("f", a.alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") != a).cast("int").alias("side"), "id", *columns)
        return rows.repartition("f", "a", "b").sortWithinPartitions("f", "a", "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, filters = [], []
        for part in _groups(batches, 3):
            left, right, same = _sides(part)
            id_, s, t, far = *(part.column(i).to_numpy() for i in (4, 5, 6)), BITS if exact else _sketch(part.column(7)[0].as_py(), cosine).far
            apart = np.bitwise_count(s[left][:, None] ^ s[right][None, :]) + np.bitwise_count(t[left][:, None] ^ t[right][None, :])
            found = apart <= far
            if same:
                np.fill_diagonal(found, False)
            stay = np.unique(np.concatenate([left[found.any(1)], right[found.any(0)]]))
            ids.append(id_[stay])
            filters.append(np.full(len(stay), part.column(0)[0].as_py()))
            if len(ids) > 500:
                yield {"id": pa.array(np.concatenate(ids)), "f": pa.array(np.concatenate(filters))}
                ids, filters = [], []
        if ids:
            yield {"id": pa.array(np.concatenate(ids)), "f": pa.array(np.concatenate(filters))}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: list[tuple] = []
        for part in _groups(batches, 3):
            if part.num_rows < 2:
                continue
            m = _Members(part)
            if not len(m.left) or not len(m.right):
                continue
            found = m.pairs(cosine)
            if not found.any():
                continue
            out += [(int(u), None, int(n)) for u, n in zip(m.id[m.left], found @ m.copies[m.right], strict=True) if n]
            if not m.same:
                out += [(int(v), None, int(n)) for v, n in zip(m.id[m.right], m.copies[m.left] @ found, strict=True) if n]
            out += [(u, v, 0) for u, v in _joined(found, m.id[m.left], m.id[m.right])]
            if len(out) > 20_000:
                yield dict(zip(("u", "v", "n"), map(list, zip(*out, strict=True)), strict=True))
                out = []
        if out:
            yield dict(zip(("u", "v", "n"), map(list, zip(*out, strict=True)), strict=True))

    stay = map_whole(dealt(rows, "s", "t", "length"), T._parse_datatype_string("id long, f long"), near)
    kept = written(stay.distinct().groupBy("id").agg(F.sort_array(F.collect_list("f")).alias("filters")), "near")
    left = kept.join(held.select("id", "copies", "vector"), "id").withColumn("f", F.explode("filters"))
    compared = map_whole(dealt(left, "copies", "vector", "filters"), T._parse_datatype_string("u long, v long, n long"), compare)
    return written(compared, "links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``; ``exact`` finds every link, at the price of all pairs."""
    new = ("n_links", "component_id", "kept")
    others = [c for c in vectors.columns if c not in new]
    fine = "size(x) > 0 AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) AND exists(x, e -> e <> 0)"
    row = F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")
    rows = vectors.select(row, F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("x"))
    usable = F.coalesce(F.expr(f"id IS NOT NULL AND {fine}"), F.lit(False))
    rows = rows.select("row", "id", F.when(usable, F.col("x")).alias("x"))
    # equal components are equal vectors, -0.0 and 0.0 too
    classes = rows.filter("x IS NOT NULL").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.select("id", "copies", F.col("x").alias("vector")), "classes")
    found = links(classes.groupBy("id", "vector").agg(F.sum("copies").alias("copies")), cosine, exact)
    degree = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    home = components(found.filter("v IS NOT NULL"))
    judged = (
        classes.join(degree, classes.id == degree.u, "left")
        .join(home, classes.id == home.node, "left")
        .select(
            F.col("vector").alias("v"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("linked"),
            F.coalesce("component", "id").alias("c"),
        )
    )
    out = rows.join(judged, rows.x == judged.v, "left").select(
        "row.*",
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(False)).alias("kept"),
    )
    return out


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")
