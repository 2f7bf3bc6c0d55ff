"""Substring dedup: words in stretches of ``WINDOW`` or more that a document with a smaller id has too are removed.

Words are what ASCII white space parts, unchanged. Every document's non-overlapping blocks of ``BLOCK`` words (from its first word on) are
indexed by hash, and every rolling window of ``BLOCK`` words of every document probes that index. As two blocks fit into a window with a
word to spare, a repeated window holds a whole block of the document that has it first, so its copy hits there. A hit is extended
to all windows around it, on both sides: windows are compared by 80 bits of hash (of all their words) beside the bits that deal them
out, and those whose first document isn't their own are repeats; adjacent ones are one maximal repeat.

Hashes travel packed, dealt out into buckets by their leading bits: a row has what one task found for a bucket. Buckets are
as many as the texts ask for, so that one's index fits a task. Tasks add up before they send: of equal blocks the index gets the
smallest document's only; of equal windows only the smallest document's and the largest's are sent, the others having their answer. So
a passage of a third of all documents is a row or two of each task. Beyond some 10 TB a row of a bucket has few entries, and packing
saves less.

Texts are shuffled once to meet their hits; those without any are done. The others are written, and meet their removed windows.

Defined results: null text has no words and the hash of the empty string; repeats within a document stay, and so do those between rows with
one id, as neither is smaller; rows that share an id are judged and returned each; a row without id removes nothing and keeps all; a text
of fewer than ``WINDOW`` words keeps all; very long texts are read in stretches, but whole; other columns are not read; an empty table stays
empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import let_go, map_batches, table, written

WINDOW, BLOCK = 50, 25
#: Words that a bucket of blocks, of windows, of documents stands for, and the least number of buckets.
OF_BLOCKS, OF_WINDOWS, OF_DOCS, LEAST = 1 << 25, 1 << 21, 1 << 21, 64
#: Hashes that a task holds, and words whose hashes it remembers.
HELD, KNOWN = 2_000_000, 500_000
#: Bytes of a text that are split at once.
STRETCH = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Odd multipliers of two rolling hashes.
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_PACKED = "docs binary, sizes binary, places binary, n_docs int, n int"
_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Ids(dict):
    """Words' 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        end = end.start() if end else len(text)
        yield text[at:end].split()
        at = end


def segments(texts: list[bytes | None], ids: Ids, overlap: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, number of the first word, hashes of words); a text's next segment begins ``overlap`` words before the last one's end."""
    for i, text in enumerate(texts):
        at, had = 0, np.zeros(0, np.uint64)
        for words in stretches(text or b""):
            own = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
            own = np.concatenate([had, own]) if len(had) else own
            yield i, at, own
            had = own[max(0, len(own) - overlap) :]
            at += len(own) - len(had)


def rolled(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of the ``length`` words from each on; the last ``length - 1`` have none."""
    power = np.cumprod(np.full(len(words), base, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    back = np.cumprod(np.full(len(words), np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
    x = (sums[length:] - sums[:-length]) * back[: len(words) - length + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(texts: list[bytes | None], ids: Ids, length: int, bases: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, hash by each base) of all windows, of a bounded number of words at a time."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def out() -> tuple[np.ndarray, ...]:
        words = np.concatenate([x for _, _, x in held])
        lengths = np.array([len(x) for _, _, x in held])
        starts = np.cumsum(lengths) - lengths
        text = np.repeat(np.array([i for i, _, _ in held]), lengths)
        place = np.arange(len(words)) - np.repeat(starts - np.array([at for _, at, _ in held]), lengths)
        inside = np.arange(len(words)) + length <= np.repeat(starts + lengths, lengths)
        inside = inside[: max(0, len(words) - length + 1)]
        return (text[: len(inside)][inside], place[: len(inside)][inside], *(rolled(words, length, b)[inside] for b in _BASES[:bases]))

    for segment in segments(texts, ids, length - 1):
        if len(segment[2]) >= length:
            held.append(segment)
            size += len(segment[2])
        if size > 200_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def shrunk(values: np.ndarray) -> bytes:
    """Numbers by the places of their bytes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def grown(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed(bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, **more: np.ndarray) -> Iterator[dict]:
    """Rows of _PACKED for each bucket, from entries in the order of documents and places; columns ``more`` (text) are of entries too."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        own = order[a:b]
        docs, places = doc[own], place[own].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        steps = np.diff(places, prepend=0)
        steps[first] = places[first]
        sizes = np.diff(np.append(first, len(own)))
        row = {"bucket": int(bucket[a]), "docs": shrunk(np.diff(docs[first], prepend=0)), "sizes": shrunk(sizes.astype(np.uint32)), "places": shrunk(steps)}
        yield row | {"n_docs": len(first), "n": len(own)} | {k: v[own].tobytes() for k, v in more.items()}


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of a row's entries."""
    docs = np.cumsum(grown(row["docs"], np.int64, row["n_docs"]))
    sizes = grown(row["sizes"], np.uint32, row["n_docs"]).astype(np.int64)
    steps = grown(row["places"], np.int64, row["n"])
    sums = np.cumsum(steps)
    start = np.cumsum(sizes) - sizes
    return np.repeat(docs, sizes), sums - np.repeat(sums[start] - steps[start], sizes)


def first_owners(name: np.ndarray, doc: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its document is the smallest with that name here, and whether it is the last entry of the largest."""
    least, last = np.ones(len(name), bool), np.zeros(len(name), bool)
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    several = np.zeros(len(name), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    own = np.flatnonzero(several)
    if len(own):
        second = np.zeros(len(name), np.uint8) if second is None else second
        own = own[np.lexsort((doc[own], second[own], name[own]))]
        new = np.concatenate([[True], (name[own][1:] != name[own][:-1]) | (second[own][1:] != second[own][:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        least[own] = doc[own] == doc[own][start]
        last[own] = np.append(new[1:], True)
    return least, last


def dealt(name: np.ndarray, buckets: int) -> np.ndarray:
    return (((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def by_doc(kind: int, doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[dict]:
    """Packed rows of distinct (document, place), dealt out by document."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]) if len(doc) else np.zeros(0, bool)
    doc, place = doc[new], place[new]
    return ({"kind": kind} | row for row in packed((doc % buckets).astype(np.int32), doc, place))


def columns(rows: list[dict], names: list[str]) -> dict:
    return {n: [r.get(n) for r in rows] for n in names}


def flowing(rows: Iterator[dict], names: list[str], most: int = 4 << 20) -> Iterator[dict]:
    """Batches of rows, of a bounded number of bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > most:
            yield columns(held, names)
            held, size = [], 0
    if held:
        yield columns(held, names)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def flat(df: DataFrame, schema: str, fn: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """mapInArrow with ``fn`` over rows as dicts."""
    kind = T._parse_datatype_string(schema)
    return map_batches(df, kind, lambda batches: flowing(fn(rows_of(batches)), kind.names))


ENTRIES = "bucket int, kind int, " + _PACKED + ", names binary, second binary, rows binary"
#: Kinds of rows: blocks of the index, probes, and answers that need none.
INDEX, PROBES, FOUND = 0, 1, 2


def anchors(docs: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """Packed blocks of the index and probes of all rolling windows, and the cells of windows that another document of the task has."""
    kind = T._parse_datatype_string(ENTRIES)

    def out(name: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[dict]:
        block = place % BLOCK == 0
        least, _ = first_owners(name[block], doc[block])
        own = np.flatnonzero(block)[least]
        yield from ({"kind": INDEX} | r for r in packed(dealt(name[own], buckets), doc[own], place[own], names=name[own].astype(np.uint32)))
        least, last = first_owners(name, doc)
        own = np.flatnonzero(least | last)
        yield from ({"kind": PROBES} | r for r in packed(dealt(name[own], buckets), doc[own], place[own], names=name[own].astype(np.uint32)))
        yield from by_doc(FOUND, doc[~least], place[~least] // BLOCK, doc_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, held, size = Ids(), [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for text, place, name in windows(batch.column(1).to_pylist(), ids, BLOCK, 1):
                held.append((name, keys[text], place))
                size += len(name)
                if size > HELD:
                    yield from flowing(out(*map(np.concatenate, zip(*held, strict=True))), kind.names)
                    held, size = [], 0
        if held:
            yield from flowing(out(*map(np.concatenate, zip(*held, strict=True))), kind.names)

    return map_batches(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), kind, run)


def hits(entries: DataFrame, doc_buckets: int) -> DataFrame:
    """Packed (document, cell) of windows that are a smaller document's block, and of that block: a cell is where ``BLOCK`` windows begin."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        now, index, table, met = None, [], None, None

        def own_blocks() -> Iterator[dict]:
            if met is not None and met.any():
                names, docs, places, of = table[3]
                yield from by_doc(FOUND, docs[met[of]], places[met[of]] // BLOCK, doc_buckets)

        def built() -> tuple:
            names, docs, places = (np.concatenate([x[i] for x in index]) for i in range(3))
            order = np.lexsort((docs, names))
            names, docs, places = names[order], docs[order], places[order]
            first = np.concatenate([[True], names[1:] != names[:-1]])
            of = np.cumsum(first) - 1
            least = docs[first]
            owner = docs == least[of]
            return names[first], least, None, (None, docs[owner], places[owner], of[owner])

        for row in rows:
            if row["kind"] == FOUND:
                yield row
                continue
            if row["bucket"] != now:
                yield from own_blocks()
                now, index, table, met = row["bucket"], [], None, None
            names = np.frombuffer(row["names"], np.uint32)
            if row["kind"] == INDEX:
                index.append((names, *unpacked(row)))
                continue
            if not index:
                continue
            if table is None:
                table = built()
                met = np.zeros(len(table[0]), bool)
            docs, places = unpacked(row)
            at = np.minimum(np.searchsorted(table[0], names), len(table[0]) - 1)
            hit = (table[0][at] == names) & (table[1][at] < docs)
            met[at[hit]] = True
            yield from by_doc(FOUND, docs[hit], places[hit] // BLOCK, doc_buckets)
        yield from own_blocks()

    # answers that need no index are spread by document; rows of a bucket meet, its index first
    where = F.when(F.col("kind") == FOUND, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    dealt_out = entries.withColumn("at", where).repartition("at").sortWithinPartitions("at", "kind")
    return flat(dealt_out.drop("at"), "bucket int, kind int, " + _PACKED, run).drop("kind")


def met(texts: DataFrame, found: DataFrame, schema: str, judge: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    """``judge`` of each row of ``texts`` (bucket, key, ...) and the places found for its key, in order."""
    names = texts.columns[1:]
    rows = found.select("bucket", F.lit(0).alias("late"), *(c.split()[0] for c in _PACKED.split(", "))).unionByName(texts.withColumn("late", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "late")

    def run(given: Iterator[dict]) -> Iterator[dict]:
        now, held, keys, places, count = None, [], None, None, 0
        for row in given:
            if row["bucket"] != now:
                now, held, keys, count = row["bucket"], [], None, 0
            if not row["late"]:
                held.append(unpacked(row))
                continue
            if keys is None:
                keys, places = (np.concatenate([x[i] for x in held]) for i in range(2)) if held else (np.zeros(0, np.int64),) * 2
                order = np.lexsort((places, keys))
                keys, places, held = keys[order], places[order], []
            a, b = (0, 0) if row["key"] is None else (np.searchsorted(keys, row["key"], side) for side in ("left", "right"))
            count += 1
            yield judge({n: row[n] for n in names} | {"row": (now << 32) + count}, np.unique(places[a:b]))

    return flat(rows, schema, run)


def judged(text: bytes | None, starts: np.ndarray) -> dict:
    """Counts and the hash of the words that no window from ``starts`` covers."""
    total = removed = 0
    out, blank = hashlib.sha256(), False
    for words in stretches(text or b""):
        if len(starts):
            a, b = np.searchsorted(starts, [total - WINDOW + 1, total + len(words)])
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.maximum(starts[a:b] - total, 0), 1)
            np.add.at(change, np.minimum(starts[a:b] - total + WINDOW, len(words)), -1)
            kept = [w for w, n in zip(words, np.cumsum(change).tolist(), strict=False) if not n]
        else:
            kept = words
        if kept:
            out.update(b" " * blank + b" ".join(kept))
            blank = True
        total += len(words)
        removed += len(words) - len(kept)
    return {"n_words": total, "n_removed": removed, "kept_sha256": out.hexdigest()}


def candidates(open_texts: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """Packed windows of the cells found; those that a smaller document of the task has are answers already."""
    kind = T._parse_datatype_string(ENTRIES)

    def out(name: np.ndarray, second: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> Iterator[dict]:
        least, _ = first_owners(name, doc, second)
        own = np.flatnonzero(least)
        more = {"names": name[own], "second": second[own], "rows": doc[own]}
        yield from ({"kind": PROBES} | r for r in packed(dealt(name[own], buckets), row[own], place[own], **more))
        yield from by_row(row[~least], place[~least])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, held, size = Ids(), [], 0
        for batch in batches:
            docs, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            cells = [np.frombuffer(x, np.int64) for x in batch.column("cells").to_pylist()]
            sizes = np.array([len(x) for x in cells])
            cell = np.repeat(np.arange(len(cells)), sizes) * (1 << 40) + np.concatenate(cells)
            for text, place, name, second in windows(batch.column("text").to_pylist(), ids, WINDOW, 2):
                at = text * (1 << 40) + place // BLOCK
                # a window is near a hit if its own cell or the next one has it
                wanted = np.isin(at, cell) | np.isin(at + 1, cell)
                text, place, name = text[wanted], place[wanted], name[wanted]
                held.append((name, second[wanted].astype(np.uint16), docs[text], rows[text], place))
                size += len(name)
                if size > HELD:
                    yield from flowing(out(*map(np.concatenate, zip(*held, strict=True))), kind.names)
                    held, size = [], 0
        if held:
            yield from flowing(out(*map(np.concatenate, zip(*held, strict=True))), kind.names)

    return map_batches(open_texts.select("doc_id", "row", "cells", "text"), kind, run)


def by_row(row: np.ndarray, place: np.ndarray) -> Iterator[dict]:
    """Packed rows of answers, dealt out as the texts' rows were."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    return ({"kind": FOUND} | r for r in packed((row >> 32).astype(np.int32), row, place))


def repeats(entries: DataFrame) -> DataFrame:
    """Packed (row, place) of windows that a smaller document has."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        now, held = None, []

        def out() -> Iterator[dict]:
            if held:
                name, second, doc, row, place = (np.concatenate([x[i] for x in held]) for i in range(5))
                least, _ = first_owners(name, doc, second)
                yield from by_row(row[~least], place[~least])

        for x in rows:
            if x["kind"] == FOUND:
                yield x
                continue
            if x["bucket"] != now:
                yield from out()
                now, held = x["bucket"], []
            held.append((np.frombuffer(x["names"], np.uint64), np.frombuffer(x["second"], np.uint16), np.frombuffer(x["rows"], np.int64), *unpacked(x)))
        yield from out()

    where = F.when(F.col("kind") == FOUND, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    dealt_out = entries.withColumn("at", where).repartition("at").sortWithinPartitions("at")
    return flat(dealt_out.drop("at"), "bucket int, kind int, " + _PACKED, run).drop("kind")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    blocks, names, by_docs = (max(LEAST, -(-words // n)) for n in (OF_BLOCKS, OF_WINDOWS, OF_DOCS))
    by_docs |= 1  # ids with a common divisor spread too

    def first(row: dict, cells: np.ndarray) -> dict:
        if len(cells):
            return {"doc_id": row["doc_id"], "row": row["row"], "cells": cells.tobytes(), "text": row["text"]}
        return {"doc_id": row["doc_id"]} | judged(row["text"], cells)

    def second(row: dict, starts: np.ndarray) -> dict:
        return {"doc_id": row["doc_id"]} | judged(row["text"], starts)

    texts = docs.select(F.coalesce(F.pmod("doc_id", F.lit(by_docs)), F.lit(0)).cast("int").alias("bucket"), F.col("doc_id").alias("key"), "doc_id", "text")
    state = written(met(texts, hits(anchors(docs, blocks, by_docs), by_docs), _DONE + ", row long, cells binary, text binary", first), "substrings")
    left = state.filter("row IS NOT NULL")
    rest = left.select(F.shiftright("row", 32).cast("int").alias("bucket"), F.col("row").alias("key"), "doc_id", "text")
    cleaned = met(rest, repeats(candidates(left, names, by_docs)), _DONE, second)
    return state.filter("row IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").union(cleaned)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
said AS (SELECT r, doc_id, unnest(a) AS word, unnest(range(len(a))) AS i FROM docs),
starts AS (SELECT r, doc_id, unnest(range(0, len(a) - 49)) AS i, a FROM docs WHERE len(a) >= 50),
named AS (SELECT r, doc_id, i, sha256(array_to_string(a[i + 1:i + 50], ' ')) AS name FROM starts),
marked AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY name) AS least FROM named),
cut AS (SELECT r, i FROM marked WHERE least < doc_id),
covered AS (SELECT DISTINCT r, i + k AS i FROM cut, (SELECT unnest(range(50)) AS k)),
kept AS (
  SELECT s.r, count(*) FILTER (WHERE c.i IS NOT NULL) AS n_removed, string_agg(s.word, ' ' ORDER BY s.i) FILTER (WHERE c.i IS NULL) AS text
  FROM said s LEFT JOIN covered c ON c.r = s.r AND c.i = s.i GROUP BY s.r)
SELECT d.doc_id, len(d.a) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON k.r = d.r
"""
