"""Source divergence audit: how unlike the sources of a language are, and by which terms, in whole numbers.

Terms are stretches of ASCII letters and characters beyond ASCII, of which A to Z are lower-cased. A language keeps the terms of at
least ``LEAST_DOCS`` of its documents. Tasks count whole texts into rows (lang, source, term), which one shuffle adds up to a row for each
term of a language. These rows are sorted by language and term over all tasks, and cut into chunks of at most ``CHUNK`` terms:
a chunk's terms are a sorted array, entries find their ids there by ``searchsorted``, and ``bincount`` makes a dense vector of each
source. Ids keep the terms' UTF-8 order, so ties break by id. A task adds up the divergence of all pairs of a language's sources over its
chunks, and keeps each source's first ``RANKS`` terms; the sums of the tasks meet in an aggregate, the terms in a ranking.

Arithmetic is of 64-bit integers and exact: shares are divided three digits at a time, squares are at most 10**18, and sums hold for
fewer than 2 * 10**9 kept terms a language.

Defined results: null text, lang and source are the empty string; every row is a document of its own, repeated rows too; a group
without kept terms has the shares of zero counts, and one of a language without kept terms has value 0 for all others; a language's only
source has no pairs; equal values rank by UTF-8; a very long text is counted in stretches; other columns are not
read; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_batches, map_whole, table, written

LEAST_DOCS, RANKS, SCALE = 3, 200, 10**9
#: Distinct (lang, source, term) that a task holds, bytes of a text split at once.
HELD, STRETCH = 400_000, 1 << 20
#: Terms of a chunk, entries of one, and cells of a block of its dense vectors.
CHUNK, ENTRIES, CELLS = 4096, 1_000_000, 1 << 18
#: Pairs of sources whose sums a task holds.
MAX_PAIRS = 4_000_000

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Bytes as terms have them: small letters and bytes of longer characters; all others are blanks.
TERMS = bytes(c if c >= 0x80 else (c | 0x20 if (c | 0x20) in _LETTERS and c >= 0x41 else 0x20) for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in stretches that end where a term does."""
    plain, at = text.translate(TERMS), 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= STRETCH else plain.find(b" ", at + STRETCH)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term, of what a task has read at a time."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[dict]:
            for (lang, source), (n, d) in held.items():
                size, words = len(n), list(n)
                yield {
                    "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int64))),
                    "source": pa.array([source], pa.string()).take(pa.array(np.zeros(size, np.int64))),
                    "term": pa.array(words, pa.string()),
                    "n": pa.array(n.values(), pa.int64()),
                    "d": pa.array([d[w] for w in words], pa.int64()),
                }

        size = 0
        for batch in batches:
            for lang, source, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for words in terms_of(data):
                    n.update(words)
                    own.update(words)
                d.update(own)
                size += len(n)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return map_batches(rows, T._parse_datatype_string("lang string, source string, term string, n long, d long"), run)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, entries): the terms a language keeps, each with its occurrences by source."""
    rows = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    each = rows.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return each.filter(F.col("d") >= least_docs).select("lang", "term", "entries")


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, v, sources): how many terms a language keeps, and its sources in order, each with its kept occurrences."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sums = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("n"))
    groups = docs.select(empty("lang"), empty("source")).distinct().join(sums, ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    return groups.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), "sources")


def chunks(kept: DataFrame) -> DataFrame:
    """(lang, terms, places, sources, counts): stretches of the sorted terms; entry i is of the term at places[i]."""
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    schema = "lang string, terms array<string>, places array<int>, sources array<string>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        lang, terms, entries = None, [], []

        def out() -> dict:
            return {
                "lang": [lang], "terms": [terms],
                "places": [np.repeat(np.arange(len(terms), dtype=np.int32), [len(e) for e in entries])],
                "sources": [[x["source"] for e in entries for x in e]], "counts": [[x["n"] for e in entries for x in e]],
            }

        size = 0
        for batch in batches:
            for own, term, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if terms and (own != lang or len(terms) == CHUNK or size + len(entry) > ENTRIES):
                    yield out()
                    terms, entries, size = [], [], 0
                lang = own
                terms.append(term)
                entries.append(entry)
                size += len(entry)
        if terms:
            yield out()

    return map_batches(ordered, T._parse_datatype_string(schema), run)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total), by long division, as the product needn't fit 64 bits."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compared(chunk: DataFrame, of_lang: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): sums of pairs and first terms, of what a task has read."""
    schema = "lang string, source string, part string, item string, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, names, sums, best = None, [], None, {}

        def out() -> Iterator[dict]:
            size = len(names)
            if sums is not None and size:
                a, b = (x[~np.eye(size, dtype=bool)] for x in np.indices((size, size)))
                item = pa.array(names, pa.string())
                for at in range(0, len(a), 50_000):
                    s, t = a[at : at + 50_000], b[at : at + 50_000]
                    yield {"lang": [now] * len(s), "source": item.take(pa.array(s)), "part": ["pair"] * len(s), "item": item.take(pa.array(t)), "value": sums[s, t]}
            for place, (values, items) in best.items():
                n = len(items)
                yield {"lang": [now] * n, "source": [names[place]] * n, "part": ["term"] * n, "item": items, "value": values}

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
                lang, v = row["lang"][0].as_py(), row["v"][0].as_py()
                groups = row["groups"][0].as_py()
                if lang != now:
                    yield from out()
                    now, names, best = lang, [g["source"] for g in groups], {}
                    sums = np.zeros((len(names),) * 2, np.int64) if len(names) ** 2 <= MAX_PAIRS else None
                totals = np.array([g["n"] for g in groups], np.int64) + v
                # ids: of terms their places, as the chunk is sorted; of sources by their sorted array
                terms = row["terms"].flatten()
                size = len(terms)
                code = np.searchsorted(np.array(names, object), np.array(row["sources"].flatten().to_pylist(), object))
                cell = code * size + row["places"].flatten().to_numpy()
                counts = row["counts"].flatten().to_numpy()
                order = np.argsort(cell, kind="stable")
                cell, code, counts = cell[order], code[order], counts[order]
                whole = exact_bincount(cell % size, counts, size)
                q = shares(whole, int(totals.sum()) - v * (len(names) - 1))
                width = max(1, CELLS // size)
                dense = []  # by block of sources
                for first in range(0, len(names), width):
                    a, b = np.searchsorted(cell, [first * size, (first + width) * size])
                    block = exact_bincount(cell[a:b] - first * size, counts[a:b], min(width, len(names) - first) * size).reshape(-1, size)
                    dense.append((first, block))
                for first, block in dense:
                    p = shares(block, totals[first : first + len(block), None])
                    over = np.where((block > 0) & (p > q), divergence(p, q), -1)
                    for k in np.flatnonzero((over >= 0).any(axis=1)):
                        merge(best, first + int(k), over[k], terms)
                    part = sums if sums is not None else np.zeros((len(block), len(names)), np.int64)
                    base = first if sums is not None else 0
                    for start, other in dense:
                        r = p if other is block else shares(other, totals[start : start + len(other), None])
                        for k in range(len(block)):
                            part[base + k, start : start + len(other)] += divergence(p[k], r).sum(axis=1)
                    if sums is None:
                        item = pa.array(names, pa.string())
                        for k in range(len(block)):
                            others = pa.array(np.delete(np.arange(len(names)), first + k))
                            n = len(others)
                            yield {"lang": [now] * n, "source": [names[first + k]] * n, "part": ["pair"] * n, "item": item.take(others), "value": part[k][others.to_numpy()]}
        yield from out()

    return map_batches(chunk.join(of_lang.withColumnRenamed("sources", "groups"), "lang"), T._parse_datatype_string(schema), run)


def exact_bincount(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """bincount() with weights, whose sums of doubles are exact up to 2**53, in two halves of the counts."""
    low, high = (np.bincount(ids, x, size).astype(np.int64) for x in (counts & 0xFFFFFF, counts >> 24))
    return low + (high << 24)


def merge(best: dict, place: int, values: np.ndarray, terms: pa.Array) -> None:
    """Puts a chunk's terms among the first of a source; equal values stand in the order of their terms, as chunks come in it."""
    found = np.flatnonzero(values >= 0)
    first = found[np.argsort(-values[found], kind="stable")[:RANKS]]
    had, items = best.get(place, (np.zeros(0, np.int64), []))
    all_values, all_items = np.concatenate([had, values[first]]), items + terms.take(pa.array(first)).to_pylist()
    order = np.argsort(-all_values, kind="stable")[:RANKS]
    best[place] = all_values[order], [all_items[x] for x in order]


def audit(docs: DataFrame) -> DataFrame:
    """Parts ``pair`` and ``term`` of every (lang, source), ranked."""
    kept = written(kept_terms(docs), "kept-terms")
    of_lang = written(languages(docs, kept), "languages")
    found = compared(chunks(kept), of_lang)
    names = of_lang.select("lang", F.explode("sources.source").alias("source"), F.col("sources.source").alias("others"))
    none = names.select("lang", "source", F.lit("pair").alias("part"), F.explode("others").alias("item"), F.lit(0).cast("long").alias("value"))
    rows = found.union(none.filter("item <> source"))  # so that languages without kept terms have their pairs
    summed = rows.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return summed.withColumn("rank", F.row_number().over(place)).filter((F.col("part") == "pair") | (F.col("rank") <= RANKS))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
said AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
occurs AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grps AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM occurs GROUP BY lang, source) USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.n + g.v) AS p
  FROM grps g JOIN kept k USING (lang) LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(total) + any_value(v)) AS q FROM shares
  JOIN (SELECT lang, any_value(v) AS v, sum(n) AS total FROM grps GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
