"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly if each token encodes to itself and each two
neighbours encode to themselves, so a nondeterministic transducer over (previous token, place in the
vocabulary trie) reads bytes and guesses where tokens end. Its subset construction is made on demand: a
state holds the live guesses and what each would emit beyond their common output; a byte drops the guesses
that leave the trie, and tokens go out as soon as all the live guesses agree on them. A guess lives no
longer than the longest token, which bounds the lookahead.

Defined results: null or empty text has no tokens; ids of no vocabulary entry raise KeyError on decoding;
bytes that are no UTF-8 decode to U+FFFD in text and stay as they are in ``decoded``; repeated rows
are encoded alike; other columns pass through, except one with an output's name, which the output replaces.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import extend, table

#: States, pairs of tokens and pieces of text that a worker remembers.
MAX_STATES = 30_000
MAX_PAIRS = 800_000
MAX_PIECES = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: join the neighbours of lowest rank, leftmost first, until no pair is known."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1))
        if rank > len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _State:
    __slots__ = ("guesses", "last", "moves", "rest")

    def __init__(self, last: int, guesses: tuple[tuple[int, tuple[int, ...]], ...]):
        self.last, self.guesses = last, guesses
        self.moves: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.rest = guesses[-1][1]  # of the one guess that all bytes so far are whole tokens


class Transducer:
    """encode(bytes) gives ids; the automaton grows as it reads."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.own: dict[int, tuple[tuple, tuple] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.without = 0
        self.start = self._state(-1, ((0, ()),))

    def _state(self, last: int, guesses: tuple) -> _State:
        state = self.states.get(key := (last, guesses))
        if state is None:
            state = self.states[key] = _State(last, guesses)
        return state

    def _edges(self, token: int) -> tuple[tuple, tuple] | None:
        """What stands at the left and at the right edge of a token while it is merged, as (bytes, from, to) in
        time; time is the highest rank merged so far. None if BPE doesn't make the token of its own bytes."""
        if token not in self.own:
            whole = self.tokens[token]
            parts, now = [whole[i : i + 1] for i in range(len(whole))], -1
            left, right = [[parts[0], -1, 1 << 60]], [[parts[-1], -1, 1 << 60]]
            while len(parts) > 1:
                ranks = [self.ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
                rank = min(ranks)
                if rank == 1 << 60:
                    break
                at, now = ranks.index(rank), max(now, rank)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                for edge, changed, part in ((left, at == 0, parts[0]), (right, at == len(parts) - 1, parts[-1])):
                    if changed:
                        edge[-1][2] = rank
                        edge.append([part, now, 1 << 60])
            self.own[token] = (tuple(map(tuple, left)), tuple(map(tuple, right))) if len(parts) == 1 else None
        return self.own[token]

    def _follows(self, last: int, token: int) -> bool:
        """Whether BPE leaves the two tokens as they are, side by side; ``last`` is -1 before the first."""
        found = self.pairs.get(last << 20 | token)
        if found is None:
            found = self._compare(last, token)
            if len(self.pairs) < MAX_PAIRS:
                self.pairs[last << 20 | token] = found
        return found

    def _compare(self, last: int, token: int) -> bool:
        """No merge of what stands at the left one's right edge and the right one's left edge comes before both
        are merged inwards."""
        mine = self._edges(token)
        if last < 0 or mine is None:
            return mine is not None
        rank_of = self.ranks.get
        for a, a_from, a_to in self._edges(last)[1]:
            for b, b_from, b_to in mine[0]:
                rank = rank_of(a + b)
                if rank is not None and rank < a_to and rank <= b_to and a_from < b_to and b_from < a_to:
                    return False
        return True

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        live, whole, last = [], None, state.last
        for node, held in state.guesses:  # the longest open token first
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                live.append((child, held))
            token = self.token_at[child]
            if whole is None and token >= 0 and self._follows(held[-1] if held else last, token):
                whole = (*held, token)  # a text has one encoding, so no other guess can end here
        live.append((0, whole))
        agreed = 0
        for token in whole:
            if any(len(h) <= agreed or h[agreed] != token for _, h in live):
                break
            agreed += 1
        if agreed:
            live = [(n, h[agreed:]) for n, h in live]
        return self._state(whole[agreed - 1] if agreed else last, tuple(live)), whole[:agreed]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if self.without > 500 * self.max_states:
            self._reset()
        state, out = self.start, []
        for byte in piece:
            move = state.moves.get(byte)
            if move is None:
                if len(self.states) >= self.max_states:
                    self.without += 1
                    return self.run_undetermined(piece)
                move = state.moves[byte] = self._move(state, byte)
            state, emitted = move
            out += emitted
        out += state.rest
        return out

    def run_undetermined(self, piece: bytes) -> list[int]:
        """The nondeterministic transducer on a piece that needs a state which the full table doesn't hold. What
        is met first is met most often, so a full table stays, and starts anew after a long while."""
        children, token_at, known, follows = self.children, self.token_at, self.pairs.get, self._follows
        n = len(piece)
        last, begin = [-1] + [-2] * n, [0] * (n + 1)
        for at in range(n):
            node, before = 0, last[at]
            for end in range(at, n):
                node = children[node].get(piece[end])
                if node is None:
                    break
                token = token_at[node]
                if token >= 0 and last[end + 1] == -2:
                    found = known(before << 20 | token)
                    if follows(before, token) if found is None else found:
                        last[end + 1], begin[end + 1] = token, at
        out = []
        while n:
            out.append(last[n])
            n = begin[n]
        return out[::-1]


class _Pieces(dict):
    """Piece of text to the bytes of its ids, made by the transducer when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.transducer.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64 and len(self) < MAX_PIECES:
            self[piece] = ids
        return ids


class _Chunks(dict):
    """What stands between single spaces to the bytes of its ids, the space before it included."""

    def __init__(self, pieces: _Pieces, pattern: str):
        super().__init__()
        self.pieces, self.split, self.missed = pieces, regex.compile(pattern).findall, 0
        self.loose = regex.compile(r" (?:\s|\Z)").search
        self.ends_at_space = pattern == public_pattern()

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, self.split(f" {chunk}")))
        self.missed += 1
        if len(chunk) <= 64 and len(self) < MAX_PIECES:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """A space before a character that is no white space always begins a match of the public pattern, so
        texts are cut there; other spaces leave the whole text to the pattern."""
        if not self.ends_at_space or self.loose(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, self.split(first)), *map(self.__getitem__, rest)])


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Utf8Machine:
    """Incremental UTF-8: ``need`` continuation bytes are still due, the first within ``low``..``high``."""

    def __init__(self):
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def _step(self, byte: int) -> bool:
        """Takes a byte; false if it can't stand here."""
        if self.need:
            ok = self.low <= byte <= self.high
            self.low, self.high, self.need = 0x80, 0xBF, self.need - 1 if ok else 0
            return ok
        self.low, self.high = 0x80, 0xBF
        if byte < 0x80:
            return True
        if 0xC2 <= byte <= 0xDF:
            self.need = 1
        elif 0xE0 <= byte <= 0xEF:
            self.need, self.low, self.high = 2, (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
        elif 0xF0 <= byte <= 0xF4:
            self.need, self.low, self.high = 3, (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
        else:
            return False
        return True

    def feed(self, chunk: bytes) -> str:
        """The text that is complete; the bytes of an unfinished character stay held."""
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # a character is unfinished only within the last three bytes
            if data[-back] & 0xC0 != 0x80:
                self.need = 0
                if all([self._step(b) for b in data[-back:]]) and self.need:
                    cut -= back
                break
        self.held, self.need = data[cut:], 0
        return data[:cut].decode("utf-8", errors="replace")

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", errors="replace"), b""
        return rest


def decode_stream(blocks, tokens: dict[int, bytes]):
    """Blocks of ids to pieces of text, whole characters only."""
    machine = Utf8Machine()
    for ids in blocks:
        yield machine.feed(b"".join(tokens[int(i)] for i in ids))
    yield machine.close()


_worker: dict[tuple[str, str], _Chunks] = {}


def _loaded(path: str, pattern: str) -> _Chunks:
    if (path, pattern) not in _worker:
        _worker[path, pattern] = _Chunks(_Pieces(Transducer(read_ranks(path))), pattern)
    chunks = _worker[path, pattern]
    if chunks.missed > 40 * MAX_PIECES:  # other texts by now
        chunks.missed = 0
        chunks.clear()
        chunks.pieces.clear()
    return chunks


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of its whole text as little-endian unsigned 32-bit integers in a binary column."""
    return extend(df, f"`{ids}` binary", lambda batch: {ids: _encoded(batch.column(text).to_pylist(), path, pattern)})


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids stand for, decoded block by block."""
    return extend(df, f"`{text}` string", lambda batch: {text: _decoded(batch.column(ids).to_pylist(), path)})


def round_trip(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """encode() and decode() in one pass over the rows."""

    def run(batch: pa.RecordBatch) -> dict:
        made = _encoded(batch.column(text).to_pylist(), path, pattern)
        return {ids: made, decoded: _decoded(made, path)}

    return extend(df, f"`{ids}` binary, `{decoded}` string", run)


def _encoded(texts: list[str | None], path: str, pattern: str) -> list[bytes]:
    one = _loaded(path, pattern).encode
    return [one(x) if x else b"" for x in texts]


_vocabularies: dict[str, dict[int, bytes]] = {}
#: Ids that the decoder takes at once.
BLOCK = 65_536


def _decoded(held: list[bytes | None], path: str) -> list[str]:
    if path not in _vocabularies:
        _vocabularies[path] = {rank: token for token, rank in read_ranks(path).items()}
    get, out = _vocabularies[path].__getitem__, []
    for ids in (np.frombuffer(x or b"", "<u4") for x in held):
        machine, parts = Utf8Machine(), []
        for at in range(0, len(ids), BLOCK):
            parts.append(machine.feed(b"".join(map(get, ids[at : at + BLOCK].tolist()))))
        parts.append(machine.close())
        out.append("".join(parts))
    return out


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
