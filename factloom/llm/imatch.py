"""Document fingerprints by I-Match.

A term is a word between white space, lower-cased and without punctuation at its ends. Terms whose document
share lies within a band (neither rare nor everywhere) are the lexicon; shares are exact, over all documents, and
as a term of the band is in ``LOW`` of all documents at least, the lexicon has no more than (mean distinct terms
of a document) / ``LOW`` entries, whatever the size of the corpus. A document's distinct lexicon terms, sorted,
are hashed once for each of ``SUBSETS`` randomised parts of the lexicon. One rate for all parts would suit one length
of text only, so parts come at rates 1/2, 1/4, ...; a document carries the hashes of the two rates that leave a part
half a term to one, and a quarter to a half, and documents are compared at the rates that both carry.

The likeness of two fingerprints is the share of equal hashes among the parts in which either has a term.

The neighbour of a document is found without a global order in one task: ids are cut into ranges of about ``RANGE_ROWS``
documents (more only where there would be more than ``MAX_RANGES``, whose ends are held everywhere), an id that fills ranges by
itself is cut by its texts' hashes, each range also gets the first document of the next one, and each task reads its ranges
in descending id.

Defined results: null is the empty text, with no terms; documents with fewer than ``FEW`` lexicon terms use all their
terms; texts without terms have equal fingerprints of likeness 1; rows of one id follow each other by their texts'
hashes; null ids come after all others; a single document follows itself; an empty table stays empty. Only the key and
text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_batches, table

#: The band, as shares of all documents that hold a term: idf between -ln(HIGH) and -ln(LOW).
LOW, HIGH = 0.0005, 0.15
SUBSETS, FEW = 32, 8
#: Documents of a range of ids, and ranges at most (32 bytes each, with every task); words that a worker remembers or counts.
RANGE_ROWS, MAX_RANGES, MAX_WORDS = 2000, 200_000, 400_000
ENDS = ".,;:!?\"'()[]{}<>|*#%$&-_/\\=+~`^"
_FACTORS = np.random.default_rng(20).integers(1, 2**63, SUBSETS).astype(np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_of(word: str) -> str:
    return word.lower().strip(ENDS)


def hash_of(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


class _Terms(dict):
    """Word as it stands to the hash of its term; 0 for none, and for terms outside the band, if there is one."""

    def __init__(self, band: frozenset[int] | None = None):
        super().__init__()
        self.band = band

    def __missing__(self, word: str) -> int:
        term = term_of(word)
        value = (hash_of(term) or 1) if term else 0
        if self.band is not None and value not in self.band:
            value = 0
        if len(self) < MAX_WORDS and len(word) < 64:
            self[word] = value
        return value


#: A worker's tables, for all its tasks.
_all_terms = _Terms()
_makers: dict[int, Fingerprinter] = {}


def document_shares(docs: DataFrame, text: str) -> DataFrame:
    """(term hash, documents that hold it), added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        terms, count = _all_terms, Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                count.update(set(map(terms.__getitem__, (x or "").split())))
            if len(count) > 2 * MAX_WORDS:
                yield {"term": list(count), "n": list(count.values())}
                count = Counter()
        yield {"term": list(count), "n": list(count.values())}

    schema = T._parse_datatype_string("term long, n long")
    counted = map_batches(docs.select(F.col(f"`{text}`")), schema, run)
    return counted.filter("term <> 0").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The band's term hashes, sorted; their number is bounded, see above."""
    n = docs.count()
    band = document_shares(docs, text).filter(F.col("n").between(max(2, math.ceil(low * n)), math.floor(high * n)))
    return np.sort(np.array([r.term for r in band.select("term").toLocalIterator()], np.int64))


class Fingerprinter:
    def __init__(self, band: np.ndarray):
        self.terms = _Terms(frozenset(band.tolist()))

    def hashes(self, text: str) -> tuple[int, np.ndarray]:
        """The denser rate's level, and (2, SUBSETS) hashes; 0 where the part has no term of the text."""
        words = text.split()
        kept = set(map(self.terms.__getitem__, words))
        kept.discard(0)
        if len(kept) < FEW:
            kept = set(map(_all_terms.__getitem__, words))
            kept.discard(0)
        terms = np.sort(np.fromiter(kept, np.int64, len(kept))).view(np.uint64)
        level = len(terms).bit_length()
        out = np.zeros((2, SUBSETS), np.uint32)
        with np.errstate(over="ignore"):
            draw = terms[:, None] * _FACTORS  # terms are hashes, so high bits of products draw well
            at, part = np.divmod(np.flatnonzero(draw <= np.uint64((1 << (64 - level)) - 1)), SUBSETS)
            value = _mix(terms[at]) | np.uint64(1)
            for i in (0, 1):
                held = draw[at, part] <= np.uint64((1 << (64 - level - i)) - 1)
                digest = np.zeros(SUBSETS, np.uint64)
                np.add.at(digest, part[held], value[held])
                filled = np.bincount(part[held], minlength=SUBSETS) > 0
                out[i] = np.where(filled, np.maximum(_mix(digest) >> np.uint64(32), np.uint64(1)), 0)
        return level, out


def _maker(band: np.ndarray) -> Fingerprinter:
    key = zlib.crc32(band.tobytes())
    if key not in _makers:
        _makers.clear()
        _all_terms.clear()
        _makers[key] = Fingerprinter(band)
    return _makers[key]


def shown(made: tuple[int, np.ndarray]) -> str:
    return f"{made[0]:02x}{made[1].astype('>u4').tobytes().hex()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    data = np.frombuffer(bytes.fromhex(fingerprint[2:]), ">u4").astype(np.uint32)
    return int(fingerprint[:2], 16), data.reshape(2, -1)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: equal hashes among the parts that aren't empty in both, at the rates that both carry."""
    shift = a[0] - b[0]
    if abs(shift) > 1:
        return 0.0
    x, y = (a[1], b[1]) if shift == 0 else (a[1][:1], b[1][1:]) if shift == 1 else (a[1][1:], b[1][:1])
    used = (x != 0) | (y != 0)
    if not used.any():
        return float(np.array_equal(a[1], b[1]))
    return 1.0 if shift == 0 and np.array_equal(a[1], b[1]) else float(((x == y) & used).sum() / used.sum())


def fingerprints(docs: DataFrame, band: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of its whole text."""
    from factloom.llm.common import extend

    shared = docs.sparkSession.sparkContext.broadcast(band)

    def run(batch: pa.RecordBatch) -> dict:
        maker = _maker(shared.value)
        return {"fingerprint": [shown(maker.hashes(x or "")) for x in batch.column(text).to_pylist()]}

    return extend(docs, "fingerprint string", run)


class Ranges:
    """Ranges of (null, id from high to low, hash of the text), numbered in order."""

    def __init__(self, ends: np.ndarray, often: dict[int | None, int]):
        """ends: upper ends of ranges of complements of ids; often: ids' complements that fill so many ranges each."""
        alone = [x for k in often if k is not None for x in (k - 1, k) if x >= -(2**63)]
        self.ends = np.unique(np.concatenate([ends, np.array(alone, np.int64)]))
        self.parts = np.ones(len(self.ends) + 2, np.int64)  # of each; the last is that of null ids
        for k, n in often.items():
            self.parts[-1 if k is None else np.searchsorted(self.ends, k)] = n
        self.start = np.cumsum(self.parts) - self.parts
        self.first = None

    def of(self, k: np.ndarray, null: np.ndarray, th: np.ndarray) -> np.ndarray:
        i = np.where(null, len(self.parts) - 1, np.searchsorted(self.ends, k))
        share = (th.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(33)  # in the order of the signed hashes
        return self.start[i] + (share.astype(np.int64) * self.parts[i] >> 31)

    def hand_over(self, firsts: list[tuple[int, int, int]]) -> None:
        """firsts: (range, complement, hash) of each range's first document, which the range before gets too."""
        rows = np.array(sorted(firsts), np.int64).reshape(-1, 3)
        self.first = rows, np.roll(rows[:, 0], 1)

    def previous(self, r: np.ndarray, k: np.ndarray, th: np.ndarray) -> np.ndarray:
        """The range before, for documents that are their range's first; else -1."""
        rows, before = self.first
        at = np.searchsorted(rows[:, 0], r)
        return np.where((rows[at, 1] == k) & (rows[at, 2] == th), before[at], -1)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, z, th, t): complements of ids, which ascend where ids descend and are there for every id; null ids are 0 and marked."""
    id_ = F.col(f"`{key}`").cast("long")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.bitwise_not(id_), F.lit(0)).alias("k"), id_.isNull().alias("z"), F.xxhash64(body).alias("th"), body.alias("t"))


def _ranges(rows: DataFrame) -> Ranges:
    ids = rows.select("k", "z", "th")
    total = rows.count()
    count = min(MAX_RANGES, max(1, math.ceil(total / RANGE_ROWS)))
    shares = [(i + 1) / count for i in range(count - 1)]
    found = ids.filter("NOT z").select(F.percentile_approx("k", shares, 10 * count)).first()[0] if shares else []
    least = max(RANGE_ROWS, total / MAX_RANGES)  # so that there are MAX_RANGES at most
    often = ids.groupBy("k", "z").count().filter(F.col("count") > least).collect()
    ranges = Ranges(np.array(found or [], np.int64), {None if r.z else r.k: math.ceil(r["count"] / least) for r in often})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first: dict[int, tuple[int, int]] = {}
        for batch in batches:
            k, th = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            r = ranges.of(k, batch.column(1).to_numpy(zero_copy_only=False), th)
            for x in zip(r.tolist(), k.tolist(), th.tolist(), strict=True):
                first[x[0]] = min(x[1:], first.get(x[0], x[1:]))
        yield {"r": list(first), "k": [x[0] for x in first.values()], "th": [x[1] for x in first.values()]}

    firsts = map_batches(ids, T._parse_datatype_string("r long, k long, th long"), run).groupBy("r").agg(F.min(F.struct("k", "th")).alias("x"))
    ranges.hand_over([(r.r, r.x.k, r.x.th) for r in firsts.collect()])  # 3 * MAX_RANGES at most
    return ranges


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (r, late, k, z, th, own, size, body): each range of ids, sorted, with the first document of the next behind it.
    Texts are compressed for the exchange."""
    rows = _keyed(docs, key, text)
    ranges = _ranges(rows)
    last = int(ranges.first[0][:, 0].max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            out = {c: [] for c in ("r", "late", "k", "z", "th", "own", "size", "body")}
            k, z, th = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            r = ranges.of(k, z, th)
            before = ranges.previous(r, k, th)
            for place, prior, k_, z_, th_, x in zip(r.tolist(), before.tolist(), k.tolist(), z.tolist(), th.tolist(), batch.column(3).to_pylist(), strict=True):
                data = x.encode()
                body = codec.compress(data, asbytes=True)
                places = [(place, 0, 1)]
                if prior >= 0:  # behind all of the range before; the very first document, behind the last range
                    places.append((prior, 1, 0))
                for to, late, own in places:
                    for c, v in zip(out, (to, late, k_, z_, th_, own, len(data), body), strict=True):
                        out[c].append(v)
            yield out

    schema = T._parse_datatype_string("r long, late int, k long, z boolean, th long, own int, size long, body binary")
    made = map_batches(rows, schema, run)
    return made.repartition(max(1, min(last + 1, -(-(last + 1) // 3))), "r").sortWithinPartitions("r", "late", "z", "k", "th", "body")


EDITED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, band: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text (the last third replaced by the beginning of the
    next document, in descending order of the key) and of the next document."""
    shared = docs.sparkSession.sparkContext.broadcast(band)
    schema = T._parse_datatype_string(EDITED)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        codec, held = pa.Codec("zstd", 1), None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("r", "k", "z", "own", "size", "body")), strict=True)
            for r, k, z, own, size, body in rows:
                data = codec.decompress(body, size, asbytes=True).decode() if size else ""
                now = (r, None if z else ~k, own, data)
                if held is not None and held[0] == r and held[2]:
                    yield held, now
                held = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        maker, out = _maker(shared.value), []
        last: dict[str, tuple] = {}  # fingerprints of the last texts

        def flush() -> dict:
            columns = dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True))
            out.clear()
            return columns

        for (_, k, _, own), (_, _, _, following) in pairs(batches):
            mine = last.get(own) or maker.hashes(own)
            after = mine if own == following else maker.hashes(following)
            n = len(own)
            edited = own[: n - n // 3] + following[: n // 3]
            changed = last.get(edited) or maker.hashes(edited)
            last = {own: mine, following: after, edited: changed}
            out.append((k, n, edited, shown(mine), shown(changed), likeness(mine, changed), 1.0 if own == following else likeness(mine, after)))
            if len(out) >= 256:
                yield flush()
        if out:
            yield flush()

    return map_batches(neighbours(docs, key, text), schema, run)


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_fingerprints(docs, lexicon(docs)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
