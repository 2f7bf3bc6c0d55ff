"""Mixture-controlled packing of token ids into sequences.

Every source is a queue of tokens (its documents, each closed by an end id, in the order they were written),
cut into slots of ``slot`` tokens. Deficit round-robin serves the queues: in each round a queue's deficit grows
by a quantum in proportion to its target weight, and it sends a slot as soon as its deficit pays for one; what
is left over stays for later rounds, windows and partitions. With quanta as small as you like, slot k of a
queue of weight w goes out at time (k + 1) / w, so the place of a slot in the stream is a count over the
queues, ``sum(min(slots, floor(weight * time)))``: every task works it out alone from the queues' totals, and
no window, however far into the corpus, is further than a slot per queue from its proportions. The rests of
the queues, less than a slot each, come last; the stream is then cut every ``window`` tokens, so only the
last sequence can need padding.

Ids are made once and written to the shared folder with each document's place in its queue within its part;
the place of the parts follows from their sums. With more sources than ``MAX_QUEUES`` no task can hold all totals; then
the slots themselves are sorted by their times, over all tasks, and pieces are joined with their slots' places. Proportions and
weights hold by source either way.

Defined results: null or empty text gives the end id alone; a null source is a queue of its own; rows with
the same key are packed each; an empty table gives no pieces; other columns than key, text and source are
not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_batches, table, written

WINDOW = 2048
#: Tokens that a queue sends at once; divides the window.
SLOT = 256
#: Queues whose totals the driver holds.
MAX_QUEUES = 4096
#: Words that a worker remembers.
MAX_WORDS = 400_000

_tokenizers: dict[str, tuple] = {}


class _Words(dict):
    """Words to ids. What comes first comes most often, so a full table stays, and starts anew after a long while."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.beyond, self.letters = tokenizer, 0, {}
        # A word of Latin-1 small letters is one stretch for the splitter and is left alone by the normaliser, so
        # the tokenizer's model gets it at once; held against the whole tokenizer here, and not used if that differs.
        tried = ["the", "thing", "qu", "zwischen", "\xe9t\xe9", "ni\xf1o", "stra\xdfe", "\xfc"]
        self.direct = all(self._model(w) == self._whole(w) for w in tried)
        self.direct &= all(self._whole(f"{w},!!") == self._whole(w) + self._whole(",!!") for w in tried)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> bytes:
        if not word.isascii():
            for c in set(word) - self.letters.keys():
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
                self.letters[c] = "".join(p for p, _ in pieces)
            word = "".join(map(self.letters.__getitem__, word))
        return array("I", [x.id for x in self.tokenizer.model.tokenize(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.direct and word.isalpha() and _plain(word):
            ids = self._model(word)
        elif self.direct and (core := word.rstrip(MARKS)) != word and core.isalpha() and _plain(core):
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = self._whole(word)
        if len(self) < MAX_WORDS:
            self[word] = ids
        else:
            self.beyond += 1
        return ids


#: Marks that end words; the splitter parts them from letters. An apostrophe may begin a contraction.
MARKS = ".,;:!?*%$#&)]}|"


def _plain(word: str) -> bool:
    return word == word.lower() and (word.isascii() or max(word) <= "\xff")


def _words(path: str) -> _Words:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = _Words(Tokenizer.from_file(path))
    return _tokenizers[path]


#: str.split() also splits at these, which the tokenizers take for symbols.
NO_SPACE = "\x1c\x1d\x1e\x1f"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids as little-endian unsigned 32-bit integers. White space parts what this kind of tokenizer merges, so
    each word is encoded once and remembered."""
    words = _words(path)
    if words.beyond > 40 * MAX_WORDS:  # other texts by now
        words.beyond = 0
        words.clear()
    odd = [i for i, x in enumerate(texts) if any(c in x for c in NO_SPACE)]
    # the tokenizers lower-case too; where that may hang on a letter's surroundings, it is left to them
    split = [(x.lower() if words.direct and (x.isascii() or _latin(x)) else x).split() for x in texts]
    for i in odd:
        split[i] = []
    get = words.__getitem__
    out = [b"".join(map(get, x)) for x in split]
    for i in odd:
        out[i] = np.array(words.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
    return out


def tokenize(docs: DataFrame, path: str, key: str, text: str, source: str, end_id: int) -> DataFrame:
    """Written rows (key, queue, part, queue_start, n, ids): ``queue_start`` counts the tokens of the same queue
    before the document in its part."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("queue", T.StringType()),
            T.StructField("part", T.LongType()),
            T.StructField("queue_start", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = encode_texts([x or "" for x in batch.column(2).to_pylist()], path)
            ids = [x + end for x in ids]
            queues, starts = batch.column(1).to_pylist(), []
            for q, x in zip(queues, ids, strict=True):
                starts.append(before.get(q, 0))
                before[q] = starts[-1] + len(x) // 4
            narrow = [_narrow(x) for x in ids]
            yield {"key": batch.column(0), "queue": queues, "part": [part] * len(ids), "queue_start": starts,
                   "n": [len(x) // 4 for x in ids], "ids": narrow}

    queue = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    chosen = docs.select(F.col(f"`{key}`").alias("key"), queue.alias("queue"), F.col(f"`{text}`").alias("text"))
    return written(map_batches(chosen, schema, run), "tokens")


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where they suffice, marked by the first byte."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 65_536 else b"\x04" + ids


def _widen(held: bytes) -> np.ndarray:
    return np.frombuffer(held, "<u2" if held[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


class Schedule:
    """Places in the stream, from the queues' totals and weights."""

    def __init__(self, totals: dict[int, int], slot: int, window: int, weights: dict[int, int] | None = None):
        self.slot, self.window, self.queues = slot, window, sorted(totals)
        self.at = {q: i for i, q in enumerate(self.queues)}
        self.slots = np.array([totals[q] // slot for q in self.queues], object)
        self.weights = np.array([(weights or {}).get(q) or max(1, totals[q] // slot) for q in self.queues], object)
        if max(self.weights, default=0) < 2**31 and max(self.slots, default=0) < 2**31:
            self.slots, self.weights = self.slots.astype(np.int64), self.weights.astype(np.int64)
        rests = [totals[q] % slot for q in self.queues]
        self.rest_at = slot * int(sum(self.slots)) + np.concatenate([[0], np.cumsum(rests)]).astype(np.int64)

    def slot_places(self, q: int, k: np.ndarray) -> np.ndarray:
        """Slots of all queues that go out before slot k of queue q; ties by queue."""
        i, served = self.at[q], (k + 1).astype(self.weights.dtype)
        place = np.zeros(len(k), self.weights.dtype)
        for j in range(len(self.queues)):
            paid = self.weights[j] * served
            paid = paid // self.weights[i] if j <= i else (paid - 1) // self.weights[i]
            place += np.minimum(self.slots[j], paid)
        return place.astype(np.int64) - 1

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, token of the row, tokens, place in the stream) of what documents are cut into."""
        slot = self.slot
        first, last = start // slot, (start + n - 1) // slot
        count = last - first + 1
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        lo, hi = np.maximum(start[row], k * slot), np.minimum((start + n)[row], (k + 1) * slot)
        place = np.empty(len(row), np.int64)
        for q in np.unique(queue):
            mine = np.flatnonzero(queue[row] == q)
            slots = int(self.slots[self.at[q]])
            full = k[mine] < slots
            distinct, back = np.unique(k[mine][full], return_inverse=True)
            place[mine[full]] = self.slot_places(q, distinct)[back] * slot + lo[mine[full]] % slot
            rest = mine[~full]
            place[rest] = self.rest_at[self.at[q]] + lo[rest] - slots * slot
        token, length = lo - start[row], hi - lo
        over = place // self.window != (place + length - 1) // self.window  # only rests can straddle
        cut = self.window - place[over] % self.window
        row, token = np.concatenate([row, row[over]]), np.concatenate([token, token[over] + cut])
        length, place = np.concatenate([length, length[over] - cut]), np.concatenate([place, place[over] + cut])
        length[: len(over)][over] = cut
        order = np.lexsort([token, row])
        row, token, length, place = (x[order] for x in (row, token, length, place))
        joins = np.zeros(len(row), bool)  # neighbours in the stream and in the document are one piece
        joins[1:] = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + length[:-1]) & (place[1:] % self.window != 0)
        heads = np.flatnonzero(~joins)
        return row[heads], token[heads], np.add.reduceat(length, heads) if len(heads) else length, place[heads]


def before(rows: DataFrame, order: list[str], amount: str, label: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows that come earlier in ``order``, as ``before``: sorted in ranges, each task
    adds up its own, and the ranges' sums, a row for each, are added up at last."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.cumsum(batch.column(amount).to_numpy())
            columns = {n: batch.column(n) for n in names}
            yield columns | {"__part": [part] * len(own), "before": pa.array(total + own - batch.column(amount).to_numpy())}
            total += int(own[-1]) if len(own) else 0

    held = written(map_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order), schema, run), label)
    sums = held.groupBy("__part").agg(F.sum(amount).alias("n")).withColumn("one", F.lit(1))  # a row for each range
    earlier = Window.partitionBy("one").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    return held.join(F.broadcast(base), "__part").withColumn("before", F.col("before") + F.col("__base")).drop("__part", "__base")


def _output(key: T.StructField, ids: str) -> T.StructType:
    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "queue", "sequence_id", "offset")]
    return T.StructType([key, *fields, T.StructField(ids, T.BinaryType() if ids == "ids" else T.LongType())])


def _cut(ids: np.ndarray, lo: np.ndarray, length: np.ndarray, as_crc: bool) -> pa.Array:
    """The stretches of ``ids``, or their crc32."""
    if as_crc:
        return pa.array([zlib.crc32(ids[a : a + n]) for a, n in zip(lo.tolist(), length.tolist(), strict=True)], pa.int64())
    ends = np.concatenate([[0], np.cumsum(length * 4)])
    take = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    buffers = [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(ids[take].tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(lo), buffers)


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 1,
    window: int = WINDOW, slot: int = SLOT, weights: dict[str | None, int] | None = None, as_crc: bool = False,
) -> DataFrame:
    """Pieces (key, start, length, doc_tokens, source queue, sequence_id, offset, ids) of all documents; on demand
    ``ids_crc32`` in place of the ids.

    ``weights``: target proportions by source, whole numbers; by default the sources' shares of all tokens."""
    tokens = tokenize(docs, path, key, text, source, end_id)
    sums = written(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    named = [r.queue for r in sums.select("queue").distinct().limit(MAX_QUEUES + 1).collect()]
    weights = {"n" if s is None else f"s{s}": w for s, w in (weights or {}).items()}
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(bases, ["part", "queue"]).select("key", "queue", (F.col("base") + F.col("queue_start")).alias("at"), "n", "ids")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("total"))
    made = _output(T.StructField(key, docs.schema[key].dataType), "ids_crc32" if as_crc else "ids")
    if len(named) > MAX_QUEUES:
        return _many(placed, totals, weights, made, slot, window)
    number = {q: i for i, q in enumerate(sorted(named))}
    schedule = Schedule(
        {number[r.queue]: r.total for r in totals.collect()}, slot, window, {number[q]: w for q, w in weights.items() if q in number}
    )
    pairs = [F.lit(x) for q in number.items() for x in q]
    q = F.element_at(F.create_map(*pairs), F.col("queue")).cast("long") if pairs else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        _tokenizers.clear()  # a worker that has made ids needs its words no more
        for batch in batches:
            if not batch.num_rows:
                continue
            q, at, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            row, start, length, place = schedule.pieces(q, at, n)
            ids = np.concatenate([_widen(x) for x in batch.column(4).to_pylist()])
            held = _cut(ids, (np.cumsum(n) - n)[row] + start, length, as_crc)
            yield {key: batch.column(0).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length),
                   "doc_tokens": pa.array(n[row]), "queue": pa.array(q[row]), "sequence_id": pa.array(place // window),
                   "offset": pa.array(place % window), made.names[-1]: held}

    return map_batches(placed.select("key", q.alias("q"), "at", "n", "ids"), made, run)


def _many(placed: DataFrame, totals: DataFrame, weights: dict[str, int], made: T.StructType, slot: int, window: int) -> DataFrame:
    """Pieces where sources are too many for one task: a slot's place is its rank by (time, queue)."""
    spark = placed.sparkSession
    given = spark.createDataFrame([(q, int(w)) for q, w in weights.items()], "queue string, weight long")
    queues = totals.join(given, "queue", "left").withColumn("slots", F.floor(F.col("total") / slot)).withColumn("rest", F.col("total") % slot)
    queues = queues.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.greatest(F.lit(1), F.col("slots"))))
    queues = before(queues.select("queue", "total", "slots", "rest", "weight"), ["queue"], "rest", "queues")
    queues = queues.withColumnRenamed("before", "rests").withColumn("number", F.xxhash64("queue"))
    full = F.col("slots") * slot
    rows = placed.join(queues, "queue").withColumn("doc", F.struct("key", "at"))
    first, last = F.ceil(F.col("at") / slot), F.floor((F.col("at") + F.col("n") - 1) / slot)
    begun = rows.withColumn("last", F.least(last, F.col("slots") - 1)).filter(first <= F.col("last"))
    slots = begun.select("queue", "weight", F.explode(F.sequence(first, F.col("last"))).alias("k"))
    times = slots.select("queue", "k", ((F.col("k") + 1) / F.col("weight")).alias("time"), F.lit(1).cast("long").alias("one"))
    places = before(times, ["time", "queue", "k"], "one", "slots").select("queue", "k", (F.col("before") * slot).alias("place"))
    count = totals.agg(F.sum(F.floor(F.col("total") / slot)).alias("n")).first().n or 0
    at, end = F.col("at"), F.col("at") + F.col("n")
    pieces = rows.select(
        "queue", "number", "key", "at", "n", "ids", "slots", "rests",
        F.explode(F.sequence(F.floor(at / slot), F.floor((end - 1) / slot))).alias("k"),
    )
    lo, hi = F.greatest(at, F.col("k") * slot), F.least(end, (F.col("k") + 1) * slot)
    pieces = pieces.select("queue", "number", "key", "n", "k", "slots", "rests", (lo - at).alias("start"), (hi - lo).alias("length"), (lo - F.col("k") * slot).alias("inside"),
                           F.substring("ids", 1, 1).alias("kind"), "ids")
    width = F.when(F.col("kind") == F.lit(b"\x02"), 2).otherwise(4)
    pieces = pieces.withColumn("ids", F.concat("kind", F.substring("ids", (2 + F.col("start") * width).cast("int"), (F.col("length") * width).cast("int"))))
    whole = pieces.filter("k < slots").join(places, ["queue", "k"]).withColumn("place", F.col("place") + F.col("inside"))
    rest = pieces.filter("k >= slots").withColumn("place", F.lit(count * slot).cast("long") + F.col("rests") + (F.col("k") - F.col("slots")) * slot + F.col("inside"))
    found = whole.select("key", "number", "n", "start", "length", "place", "ids").unionByName(rest.select("key", "number", "n", "start", "length", "place", "ids"))
    names, as_crc = made.names, made.names[-1] == "ids_crc32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, n, start, length, place = (batch.column(i).to_numpy() for i in range(1, 6))
            ids = np.concatenate([_widen(x) for x in batch.column(6).to_pylist()])
            fit = np.minimum(length, window - place % window)  # the rests may straddle a window
            over = np.flatnonzero(fit < length)
            row = np.concatenate([np.arange(len(n)), over])
            skip = np.concatenate([np.zeros(len(n), np.int64), fit[over]])
            size, at = np.concatenate([fit, (length - fit)[over]]), place[row] + skip
            held = _cut(ids, (np.cumsum(length) - length)[row] + skip, size, as_crc)
            yield {names[0]: batch.column(0).take(pa.array(row)), "start": pa.array(start[row] + skip), "length": pa.array(size), "doc_tokens": pa.array(n[row]),
                   "queue": pa.array(number[row]), "sequence_id": pa.array(at // window), "offset": pa.array(at % window), names[-1]: held}

    return map_batches(found, made, run)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), as_crc=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"
    )
