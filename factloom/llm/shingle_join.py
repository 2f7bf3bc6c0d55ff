"""N-gram Jaccard join: size-aware, with light and heavy sets.

A document is the set of its distinct word n-grams (64-bit hashes; the join is exact for these). Two link when the
Jaccard similarity of their sets reaches ``num / den``. Equal sets are one class, and only classes are joined.

Light sets (at most x n-grams) enumerate subsets of fixed sizes: linked sets share one of every size up to
their overlap, and sharing one of size o proves a link of sizes a and b if ``den * o >= num * (a + b - o)``. Of the sets
with a subset, those that it links are all linked to the smallest, so each only points there.

Heavy sets, and light ones that may link to them, are looked up in inverted lists of prefixes: in a common order, the
first ``n - ceil(num / den * n) + 1`` n-grams of linked sets meet. Frequent n-grams come last in that order, as a table of
counters of a fixed size tells them; any table gives a right order, a good one gives short lists. A list is scanned
with 96-bit sketches (the parity of each bin's minimum); sets whose sketches differ in more bits than linked
sets' can, but for a chance below 1e-9, are not compared. x is where enumerating costs least against scanning.

A list first names leaders: members that are near no earlier leader; others point to theirs, and to one member of
each other leader's following that is near them. A long list goes by in blocks of ascending sizes: leaders are carried
on, and members of a block without a pair are held against earlier blocks' followers. These pairs are verified on whole sets. Sets that such pairs join,
right or wrong, are a family, and every pair that a list holds and sketches allow lies within one. Only families
whose sets then are of several components are gone through again, for pairs of different components: by sketches of
1024 bits, then by whole sets, chunk against chunk where a family is large, and only links leave the task. So a
group of thousands of copies costs one comparison a member, while no link between components is lost.

Defined results: null or empty text, and text without words, has the empty set and links with nothing; with fewer
words than an n-gram, all of them are one; rows with equal text are equal sets; rows with a null key take part
in the join, but no component is named after them, and their own component is null if no other id is in it; other
columns than key and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_batches, table, written
from factloom.llm.components import components

#: Counters of n-grams; only those whose hash is in the first ``COUNTED`` of all are counted.
COUNTERS, COUNTED = 1 << 21, 0.3
#: A frequent n-gram's counter is so often the mean, and this at least.
OFTEN, AT_LEAST = 6, 48
#: What an entry of an inverted list costs against an enumerated subset; the largest x.
ENTRY_COST, MOST_LIGHT = 6.0, 20
SKETCH_BITS, WIDE_BITS = 96, 1024
BLOCK = 4096
#: Sets of a family that one task takes, from and to: a sixteenth of a family between these.
CHUNK, MOST_CHUNK = 256, 4096

_U = np.uint64
_pick = np.random.default_rng(2024)
_BYTE = _pick.integers(1, 2**63, 256).astype(_U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _pick.integers(1, 2**63, 64).astype(_U) | _U(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, (n >> 18) + 1 << 18)
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, _U)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of ``words`` words."""
    if len(texts) > 1 and sum(map(len, texts)) > 1_000_000:
        half = len(texts) // 2
        return shingle_sets(texts[:half], words) + shingle_sets(texts[half:], words)
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    raw = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(raw))
        white = _WHITE[raw]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        summed = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power[: len(raw)])])
        word = _mix((summed[end] - summed[begin]) * inverse[begin] + (end - begin).astype(_U) * _PLACE[63])
        bound = np.cumsum([0, *(len(x) + 1 for x in data)])
        first = np.searchsorted(begin, bound)
        rolled = np.zeros(max(0, len(word) - words + 1), _U)
        for i in range(words):
            rolled += word[i : len(word) - words + 1 + i] * _PLACE[i] if len(rolled) else rolled
        rolled = _mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                out.append(_mix((word[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U(b - a)))
            else:
                out.append(np.zeros(0, _U))
    return out


def digest(x: np.ndarray) -> int:
    """The class of a set."""
    with np.errstate(over="ignore"):
        return int((_mix(x * _PLACE[40] + _U(len(x))).sum(dtype=_U) ^ _mix(np.array([len(x)], _U))[0]).astype(np.int64))


def sketch(x: np.ndarray) -> tuple[int, int]:
    """The parity of the least hash in each of 96 bins, as 64 and 32 bits."""
    with np.errstate(over="ignore"):
        turned = np.sort(_mix(x ^ _PLACE[41]))
    bins = (turned >> _U(32)) * _U(SKETCH_BITS) >> _U(32)
    heads = np.flatnonzero(np.diff(bins.astype(np.int64), prepend=-1))
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[bins[heads].astype(np.int64)] = (_mix(turned[heads]) & _U(1)).astype(np.uint8)
    data = np.packbits(bits).tobytes()
    return int.from_bytes(data[:8], "big", signed=True), int.from_bytes(data[8:], "big", signed=True)


def wide_sketch(x: np.ndarray) -> np.ndarray:
    """The same over 1024 bins, as 16 words."""
    with np.errstate(over="ignore"):
        turned = np.sort(_mix(x ^ _PLACE[43]))
        bins = (turned >> _U(54)).astype(np.int64)
        heads = np.flatnonzero(np.diff(bins, prepend=-1))
        bits = np.zeros(WIDE_BITS, np.uint8)
        bits[bins[heads]] = (_mix(turned[heads]) & _U(1)).astype(np.uint8)
    return np.packbits(bits).view(_U)


class Rule:
    """Jaccard similarity of num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        flips = (1 - num / den) / 2  # of a sketch's bit, at the least similarity
        self.far, self.wide_far = (math.ceil(b * flips + 7.5 * math.sqrt(b * flips * (1 - flips))) for b in (SKETCH_BITS, WIDE_BITS))

    def least(self, n: int) -> int:
        """The least overlap, and the least size, of what a set of n links to."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def links(self, overlap, union):
        return self.den * overlap >= self.num * union

    def differ(self, a, b):
        """The most n-grams that one of two linked sets has and the other hasn't."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, o) for o in range(self.least(n), n + 1))


@lru_cache(maxsize=256)
def _chosen(n: int, o: int) -> np.ndarray:
    return np.array(list(combinations(range(n), o)))


def boundary(sizes: dict[int, int], rule: Rule) -> int:
    """The largest light size, by cost: subsets that light sets enumerate, and entries of lists."""

    def cost(x: int) -> float:
        light = sum(c * rule.subsets(n) for n, c in sizes.items() if 0 < n <= x)
        return light + ENTRY_COST * sum(c * rule.prefix(n) for n, c in sizes.items() if n >= rule.least(x + 1))

    return min(range(1, MOST_LIGHT + 1), key=cost)


def _pass(docs: DataFrame, words: int) -> DataFrame:
    """Written rows (row, n, c, part, counts): each document's set size and class, and each task's counters."""
    schema = T._parse_datatype_string("row struct<>, n int, c long, part int, counts binary")
    schema.fields[0].dataType = docs.schema["row"].dataType
    top = _U(int(COUNTED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counters = np.zeros(COUNTERS, np.uint16)
        for batch in batches:
            sets = shingle_sets([x or "" for x in batch.column(1).to_pylist()], words)
            low = np.concatenate([x[: np.searchsorted(x, top)] for x in sets])
            at, count = np.unique(_mix(low) % _U(COUNTERS), return_counts=True)
            at = at.astype(np.int64)
            counters[at] = np.minimum(counters[at] + count, 65_535)
            nulls = [None] * len(sets)
            yield {"row": batch.column(0), "n": [len(x) for x in sets], "c": [digest(x) for x in sets], "part": nulls, "counts": nulls}
        codec, blocks = pa.Codec("zstd", 1), np.split(counters, 32)
        kept = [i for i, b in enumerate(blocks) if b.any()]
        yield {"row": [None] * len(kept), "n": [None] * len(kept), "c": [None] * len(kept), "part": kept,
               "counts": [codec.compress(blocks[i].tobytes(), asbytes=True) for i in kept]}

    return written(map_batches(docs.select("row", "text"), schema, run), "sets")


def _frequent(made: DataFrame) -> np.ndarray:
    """Bits of the counters that frequent n-grams have, from all tasks' counters."""
    size = COUNTERS // 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec, total = pa.Codec("zstd", 1), {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(codec.decompress(data, 2 * size, asbytes=True), np.uint16)
                total[part] = total[part] + counts if part in total else counts.astype(np.uint32)
        yield {"part": list(total), "counts": [codec.compress(x.tobytes(), asbytes=True) for x in total.values()]}

    parts = made.filter("part IS NOT NULL").select("part", "counts").repartition(32, "part")
    codec, counters = pa.Codec("zstd", 1), np.zeros(COUNTERS, np.uint32)
    for r in map_batches(parts, T._parse_datatype_string("part int, counts binary"), run).collect():  # of a fixed size
        counters[r.part * size : (r.part + 1) * size] = np.frombuffer(codec.decompress(r.counts, 4 * size, asbytes=True), np.uint32)
    return np.packbits(counters > max(AT_LEAST, OFTEN * counters.mean()))


def _entries(docs: DataFrame, words: int, rule: Rule, light: int, frequent: np.ndarray) -> DataFrame:
    """Rows (e, o, c, n, s, s2): subsets that light sets enumerate (o > 0: their size), and entries of lists (o = 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    listed = rule.least(light + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits, seen = np.unpackbits(shared.value).view(bool), set()
        for batch in batches:
            out = {k: [] for k in ("e", "o", "c", "n", "s", "s2")}
            for x in shingle_sets([t or "" for t in batch.column(0).to_pylist()], words):
                n = len(x)
                if not n or (c := digest(x)) in seen:  # the task has met this class
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                found: list[tuple[np.ndarray, int]] = []
                if n <= light:
                    with np.errstate(over="ignore"):
                        mixed = _mix(x * _PLACE[42])
                        for o in range(rule.least(n), n + 1):
                            found.append((_mix(mixed[_chosen(n, o)].sum(1, dtype=_U) + _U(o)), o))
                s = s2 = 0
                if n >= listed:
                    p = rule.prefix(n)
                    often = bits[(_mix(x) % _U(COUNTERS)).astype(np.int64)]
                    rare = x[~often]
                    found.append((rare[:p] if len(rare) >= p else np.concatenate([rare, x[often][: p - len(rare)]]), 0))
                    s, s2 = sketch(x)
                for e, o in found:
                    out["e"].append(e.view(np.int64))
                    for k, v in zip(("o", "c", "n", "s", "s2"), (o, c, n, s, s2), strict=True):
                        out[k].append(np.full(len(e), v, np.int32 if k in ("o", "n", "s2") else np.int64))
            if out["e"]:
                yield {k: pa.array(np.concatenate(v)) for k, v in out.items()}

    return map_batches(docs.select("text"), T._parse_datatype_string("e long, o int, c long, n int, s long, s2 int"), run)


def _near(n: np.ndarray, s: np.ndarray, s2: np.ndarray, i, rule: Rule) -> np.ndarray:
    """Members whose sizes and sketches allow a link to member i (or, given a column of members, a matrix)."""
    a, b = n, n[i]
    # unsigned: of a negative number, the magnitude's bits would be counted
    apart = np.bitwise_count((s ^ s[i]).astype(np.uint64)).astype(np.int32) + np.bitwise_count((s2 ^ s2[i]).astype(np.uint32))
    return (rule.num * np.maximum(a, b) <= rule.den * np.minimum(a, b)) & (apart <= np.minimum(rule.far, rule.differ(a, b)))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, bool]]:
    """The rows with the same first two columns of a sorted partition, where there are several, in blocks of about
    BLOCK rows; (columns, whether more follow)."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(held[0]):
            continue
        cut = np.concatenate([[0], np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1, [len(held[0])]])
        many = np.flatnonzero(np.diff(cut[:-1]) > 1)
        for a, b in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
            yield [x[a:b] for x in held], False
        held = [x[cut[-2] :] for x in held]
        if len(held[0]) >= BLOCK:
            yield held, True
            held = [x[-1:] for x in held]  # so that its list is known to go on
    if held is not None and len(held[0]) > 1:
        yield held, False


def _forest(n: np.ndarray, s: np.ndarray, s2: np.ndarray, rule: Rule) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of near members that join all that nearness joins, and the leaders."""
    left, pairs, leaders = np.ones(len(n), bool), [], []
    star = np.zeros(len(n), np.int64)
    while left.any():
        i = int(left.argmax())
        left[i] = False
        near = _near(n, s, s2, i, rule) & left
        star[i] = star[near] = len(leaders)
        leaders.append(i)
        pairs += [(i, int(x)) for x in np.flatnonzero(near)]
        left &= ~near
    if pairs and len(leaders) > 1:
        group = np.arange(len(leaders))
        for x in sorted({x for _, x in pairs}):
            near = _near(n, s, s2, x, rule)
            near[x] = False
            other = near & (group[star] != group[star[x]])
            while other.any():
                y = int(other.argmax())
                pairs.append((x, y))
                group[group == group[star[y]]] = group[star[x]]
                other &= group[star] != group[star[x]]
    return pairs, leaders


def _near_behind(behind: Sequence[np.ndarray], members: Sequence[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Pairs of each of the members that is near any of ``behind`` with the first of these; both are c, n, s, s2."""
    out = []
    for i in range(len(members[0])):
        near = _near(*(np.append(x, y[i]) for x, y in zip(behind[1:], members[1:], strict=True)), -1, rule)[:-1]
        if near.any():
            out.append((int(members[0][i]), int(behind[0][near.argmax()])))
    return out


def _lead(entries: DataFrame, rule: Rule) -> DataFrame:
    """Written rows (u, v, kind): 0 links that subsets prove, 1 pairs to verify, 2 pairs that are of one family only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        done: set[int] = set()
        head = carried = None  # of the list that goes on
        for (e, o, n, c, s, s2), more in _lists(batches):
            if o[0] > 0:
                if head is None or head[:2] != (e[0], o[0]):
                    head = (e[0], o[0], int(n[0]), int(c[0]))
                linked = (c != head[3]) & ((rule.den + rule.num) * o >= rule.num * (n + head[2]))
                u = np.unique(c[linked]).tolist()
                if u:
                    yield {"u": u, "v": [head[3]] * len(u), "kind": [0] * len(u)}
                continue
            c, first = np.unique(c, return_index=True)
            n, s, s2 = n[first].astype(np.int64), s[first], s2[first]
            followed: list[int] = []
            led, behind = np.zeros(0, np.int64), (c[:0], n[:0], s[:0], s2[:0])
            if carried is not None and carried[0] == e[0]:
                followed, (led, *_), behind = carried[1:]
                c, n, s, s2 = (np.concatenate(x) for x in zip(carried[2], (c, n, s, s2), strict=True))
                c, first = np.unique(c, return_index=True)
                n, s, s2 = n[first], s[first], s2[first]
            elif not more:
                name = int(_mix(c.view(_U)).sum(dtype=_U).astype(np.int64))
                if name in done or len(c) < 2:  # the same sets met in another list
                    continue
                if len(done) < 300_000:
                    done.add(name)
            carried = None
            pairs, leaders = _forest(n, s, s2, rule)
            if pairs:
                u, v = np.array(pairs).T
                yield {"u": c[u].tolist(), "v": c[v].tolist(), "kind": [1] * len(u)}
            if len(behind[0]):  # new members without a pair may be near a follower of an earlier block
                lone = np.setdiff1d(leaders, np.array(pairs, np.int64).ravel())
                lone = lone[~np.isin(c[lone], np.concatenate([led, behind[0]]))]
                found = _near_behind(behind, (c[lone], n[lone], s[lone], s2[lone]), rule)
                if found:
                    yield {"u": [x for x, _ in found], "v": [x for _, x in found], "kind": [1] * len(found)}
            if more or followed:
                # followers of a list's blocks don't meet, so their leaders are of one family
                now = sorted({*followed, *c[[i for i, _ in pairs]].tolist()})
                fresh = [x for x in now if x not in set(followed)]
                one = followed[0] if followed else now[0] if now else None
                if fresh and fresh != [one]:
                    yield {"u": fresh, "v": [one] * len(fresh), "kind": [2] * len(fresh)}
                if more:
                    rest = np.setdiff1d(np.arange(len(c)), leaders)
                    behind = [np.concatenate([x, y[rest]]) for x, y in zip(behind, (c, n, s, s2), strict=True)]
                    fits = behind[1] >= rule.least(int(n.max()))  # sizes ascend, so that smaller ones link to none to come
                    carried = (e[0], now, (c[leaders], n[leaders], s[leaders], s2[leaders]), [x[fits] for x in behind])

    dealt = entries.repartition("e").sortWithinPartitions("e", "o", "n", "c").select("e", "o", "n", "c", "s", "s2")
    return written(map_batches(dealt, T._parse_datatype_string("u long, v long, kind int"), run), "lists")


def _items(pairs: DataFrame, texts: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """Written rows (c, items): the sets of all classes in pairs. texts: (j, text); reps: (c, j)."""
    wanted = pairs.select(F.col("u").alias("c")).union(pairs.select("v")).distinct().join(reps, "c")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for batch in batches:
            out = {}
            for c, x in zip(batch.column(0).to_pylist(), shingle_sets([t or "" for t in batch.column(1).to_pylist()], words), strict=True):
                if c not in seen and digest(x) == c:  # one id may stand for other texts too
                    seen.add(c)
                    out[c] = _packed(x)
            yield {"c": list(out), "items": list(out.values())}

    found = texts.join(wanted, "j").select("c", "text")
    return written(map_batches(found, T._parse_datatype_string("c long, items binary"), sets), "items")


def _linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common = int((x[at] == y).sum())
    return bool(rule.links(common, len(x) + len(y) - common))


def _verified(pairs: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) of classes that link, by their whole sets."""
    right = pairs.join(items.select(F.col("c").alias("v"), F.col("items").alias("b")), "v")
    both = right.join(items.select(F.col("c").alias("u"), F.col("items").alias("a")), "u").select("u", "v", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            mask = pa.array([_linked(_unpacked(a), _unpacked(b), rule) for a, b in sets], pa.bool_())
            yield {"u": batch.column(0).filter(mask), "v": batch.column(1).filter(mask)}

    return map_batches(both, T._parse_datatype_string("u long, v long"), compare)


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8").astype(_U)


def _across(items: DataFrame, families: DataFrame, home: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) between different components of a family."""
    member = items.select("c").join(families, F.col("c") == families.node, "left").select("c", F.coalesce("component", "c").alias("g"))
    member = member.join(home, member.c == home.node, "left").select("c", "g", F.coalesce("component", "c").alias("h"))
    size = member.groupBy("g").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    chunk = F.least(F.lit(MOST_CHUNK), F.greatest(F.lit(CHUNK), F.col("m") / 16))
    size = size.select("g", F.ceil(F.col("m") / chunk).cast("int").alias("chunks"))
    rows = member.join(size, "g").join(items, "c").withColumn("own", F.expr("cast(pmod(xxhash64(c), chunks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other").cast("long")
    rows = rows.select("g", pair.alias("p"), "c", "h", "own", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (_, p), part in groupby(stream(), key=lambda r: r[:2]):
            _, _, c, h, own, items = zip(*part, strict=True)
            if len(set(h)) < 2:
                continue
            found = _between(np.array(c), np.array(h), np.array(own) if p >> 31 != p & (2**31 - 1) else None, items, rule)
            if found:
                yield {"u": [a for a, _ in found], "v": [b for _, b in found]}

    dealt = rows.repartition("g", "p").sortWithinPartitions("g", "p", "c")
    return map_batches(dealt, T._parse_datatype_string("u long, v long"), run)


def _between(c: np.ndarray, h: np.ndarray, own: np.ndarray | None, items: tuple[bytes, ...], rule: Rule) -> list[tuple[int, int]]:
    """Links that join members of different components, as few as that takes; own: only between the two chunks."""
    sets = [_unpacked(x) for x in items]
    n = np.array([len(x) for x in sets])
    sketches = np.array([wide_sketch(x) for x in sets])
    label, out = np.unique(h, return_inverse=True)[1], []
    for i in range(len(c) - 1):
        rest = slice(i + 1, len(c))
        sizes = n[rest]
        near = (label[rest] != label[i]) & (rule.num * np.maximum(n[i], sizes) <= rule.den * np.minimum(n[i], sizes))
        if own is not None:
            near &= own[rest] != own[i]
        at = np.flatnonzero(near)
        if not len(at):
            continue
        apart = np.bitwise_count(sketches[i] ^ sketches[i + 1 + at]).sum(1, dtype=np.int32)
        for j in (i + 1 + at[apart <= np.minimum(rule.wide_far, rule.differ(n[i], sizes[at]))]).tolist():
            if label[i] != label[j] and _linked(sets[i], sets[j], rule):
                out.append((int(c[i]), int(c[j])))
                label[label == label[j]] = label[i]
    return out


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100, with_hash: bool = False
) -> DataFrame:
    """A row for each of ``docs``: its key, ``n_shingles``, and ``component_id``, the least key that links reach; on
    demand also ``text_hash``, the xxhash64 of the text."""
    rule = Rule(num, den)
    column = F.col(f"`{key}`").cast("long")
    row = F.struct(column.alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("th")).alias("row")
    base = docs.select(row, F.col(f"`{text}`").alias("text"))
    made = _pass(base, words)
    sets = made.filter("n IS NOT NULL").select("row.k", "row.th", "n", "c")
    small = sets.filter(F.col("n").between(1, 2 * MOST_LIGHT)).groupBy("n").agg(F.count("*").alias("m"))
    light = boundary({r.n: r.m for r in small.collect()}, rule)
    least_other = F.min(F.when(F.col("k").isNull(), F.col("th")))
    classes = sets.filter("n > 0").groupBy("c").agg(F.min("k").alias("k"), least_other.alias("th"))
    classes = written(classes.select("c", "k", F.coalesce("k", "th").alias("j")), "classes")
    texts, reps = base.select(F.coalesce("row.k", "row.th").alias("j"), "text"), classes.select("c", "j")

    lists = _lead(_entries(base, words, rule, light, _frequent(made)), rule)
    both = lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "kind").distinct()
    pairs, sure = both.filter("kind = 1").select("u", "v"), both.filter("kind = 0").select("u", "v")
    items = _items(pairs, texts, reps, words)
    links = written(_verified(pairs, items, rule).union(sure), "links")
    home, families = components(links), components(both)
    home = components(links.union(written(_across(items, families, home, rule), "across")))
    group = classes.join(home, classes.c == home.node, "left").select("c", F.coalesce("component", "c").alias("h"), "k")
    lowest = group.groupBy("h").agg(F.min("k").alias("lowest"))
    judged = group.join(lowest, "h").select("c", "lowest")
    return sets.join(judged, "c", "left").select(
        F.col("k").cast(docs.schema[key].dataType).alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("lowest")).alias("component_id"),
        *([F.col("th").alias("text_hash")] if with_hash else []),
    )


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_groups(docs, words=4, num=85, den=100)
