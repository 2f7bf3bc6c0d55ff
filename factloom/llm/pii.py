"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. What they lose (a card behind a phone number that runs into it, an address with
a port, a number without its plus sign) the random field looks for: stretches of neighbouring words with a digit
or an @ are cut into tokens, every run of at most ``MAX_TOKENS`` tokens that can be of a kind is a candidate, features
of the whole candidate and of what stands around it score it, and dynamic programming over token boundaries picks
the boundaries and kinds that are jointly best. Base spans stay, and candidates don't touch them. The weights are
trained here, by the gradient of the segmentations' likelihood, on stretches that ``examples`` makes from a seed.

Defined results: null text is empty and has no spans; spans are in code points, end exclusive; spans of different kinds
may overlap only among base ones; repeated rows get the same spans; other columns pass through, but those with an
output's name give way. All work is linear in a text's length: a token starts a bounded number of candidates, none
longer than ``MAX_SPAN`` (base spans have no such bound), and of these only scores are held while a stretch is gone through.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import extend, table

# The kinds in the order of results, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Tokens and code points of a candidate at most; no mailbox's name is longer.
MAX_TOKENS, MAX_SPAN = 24, 320
#: Tokens whose candidates are looked at together.
BLOCK = 1 << 14
EPOCHS, EXAMPLES, RATE = 20, 700, 0.3
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
MARK = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind that don't overlap; matches that fail their check are dropped."""
    emails, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        after = DOMAIN.match(text, at + 1) if start < at else None
        if after:
            emails.append((start, after.end()))
        done = after.end() if after else at + 1
        at = text.find("@", done)
    if not MARK.search(text):
        return {k: [] for k in KINDS}
    ips = [m.span() for m in IP.finditer(text) if all(len(d := x.lstrip("0")) < 4 and int(d or "0") < 256 for x in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def stretches(text: str) -> list[Span]:
    """Words with a digit or an @, joined where one blank parts them."""
    out: list[Span] = []
    end = -1
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > max(end, 0) and not text[start - 1].isspace():
            start -= 1
        space = SPACE.search(text, m.end())
        end = space.start() if space else len(text)
        if out and out[-1][1] + 1 == start and text[start - 1] == " ":
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FEATURES = 23


def span_features(part: str, before: str, after: str) -> np.ndarray:
    """Of the whole candidate, and of the characters around it."""
    digits = digits_of(part)
    groups = re.findall(r"[0-9]+", part)
    sizes = [len(g) for g in groups]
    marks = set(part) - set("0123456789+()")
    wordy = lambda c: c.isalnum() or (c != "" and c in "_@")
    return np.array(
        [
            1,
            luhn(digits) if digits else 0,
            len(digits) in (15, 16),
            9 <= len(digits) <= 12,
            len(digits) > 12,
            part[:1] == "+",
            "(" in part and ")" in part,
            part.count("(") != part.count(")"),
            len(marks) <= 1,
            len(groups) == 1,
            bool(sizes) and min(sizes) < 2 and len(groups) > 3,
            sizes in ([4, 4, 4, 4], [4, 6, 5], [16], [15]),
            sizes[-3:] == [3, 3, 4],
            sizes[-2:] == [3, 4],
            len(groups) == 4 and all(int(g) < 256 for g in groups),
            wordy(before),
            wordy(after[:1]),
            before in ("+", "-", ".", ",") and bool(before),
            after[:1] in ("-", "/", ":", "%") and bool(after),
            len(after) > 1 and after[0] in ".-@" and after[1].isalnum(),
            len(groups) > 5,
            sizes[:1] == [4] and sizes[1:] == [2, 2],
            bool(re.search(r"\.[A-Za-z]{2,}$", part)),
        ],
        float,
    )


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def _told(codes: np.ndarray, what: Callable[[str], bool]) -> np.ndarray:
    """``what`` of each character; none at code 0."""
    distinct, place = np.unique(codes, return_inverse=True)
    return np.array([c != 0 and what(chr(c)) for c in distinct.tolist()], bool)[place]


class Stretch:
    """A stretch's tokens, as sums over those before each, so that runs of tokens are judged by differences."""

    def __init__(self, text: str, start: int, end: int, taken: list[Span]):
        self.text, self.ends = text, np.array([start, *(m.end() for m in TOKEN.finditer(text, start, end))])
        around = text[max(0, start - 1) : end + 2].encode("utf-32-le", "surrogatepass")
        self.codes = np.concatenate([np.zeros(int(start == 0), "<u4"), np.frombuffer(around, "<u4"), np.zeros(2, "<u4")])  # from start - 1
        at, size = self.ends[:-1] - start + 1, np.diff(self.ends)
        self.first = first = self.codes[at]
        self.digit = digit = (first >= 48) & (first <= 57)
        self.n = len(size)
        self.digits, self.groups = _before(size * digit), _before(digit)
        self.of = {c: _before(first == ord(c)) for c in "@+().- "}
        self.odd = _before(~digit & ~np.isin(first, [ord(c) for c in "+().- "]))
        self.ones, self.wide = _before(digit & (size == 1)), _before(digit & (size > 3))
        self.sizes = size[digit]
        d = self.codes[1 : end - start + 1].astype(np.int64) - 48
        d = d[(d >= 0) & (d <= 9)]
        even = np.arange(len(d)) % 2 == 0
        twice = 2 * d - 9 * (d > 4)
        self.luhn = [[_before(x * p) for x in (d, twice)] for p in (even, ~even)]
        starts, stops = merged(taken)
        free = np.searchsorted(np.array(stops, np.int64), self.ends[:-1], side="right")
        self.stop = np.minimum(self.ends[:-1] + MAX_SPAN, np.array([*starts, 2**62], np.int64)[free])
        small = np.flatnonzero(digit)
        value = np.array([int(text[a:b]) if b - a < 4 or text[a] == "0" and b - a < 20 else 256 for a, b in zip(self.ends[small].tolist(), self.ends[small + 1].tolist(), strict=True)], object)
        self.large = _before(value > 255) if len(small) else np.zeros(1, int)

    def numbers(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates without an @ that begin at tokens lo to hi: (first token, end token, (3, count) whether each can be
        an ip, a card, a phone, features), by first token."""
        i = lo + np.flatnonzero(self.digit[lo:hi] | np.isin(self.first[lo:hi], (ord("+"), ord("("))))
        i, j = (x.ravel() for x in np.broadcast_arrays(i[:, None], i[:, None] + np.arange(1, MAX_TOKENS + 1)))
        fits = j <= self.n
        i, j = i[fits], j[fits]
        count = self.digits[j] - self.digits[i]
        fits = (self.ends[j] <= self.stop[i]) & (self.odd[j] == self.odd[i]) & (count >= 4) & (count <= 19) & self.digit[j - 1]
        i, j, count = i[fits], j[fits], count[fits]
        has = {c: x[j] - x[i] for c, x in self.of.items()}
        plus, opened = self.first[i] == ord("+"), self.first[i] == ord("(")
        second = np.minimum(i + 1, self.n - 1)
        numbered = (has["+"] == plus) & (~plus | self.digit[second] | (self.first[second] == ord("(")))
        groups = self.groups[j] - self.groups[i]
        address = (j - i == 7) & (groups == 4) & (has["."] == 3) & self.digit[i] & (self.wide[j] == self.wide[i])
        card = numbered & (count >= 13) & ~plus & ~opened & (has["("] + has[")"] + has["."] == 0)
        can = np.array([address, card, numbered & (count >= 7) & (count <= 15)])
        kept = can.any(0)
        i, j, count, groups, plus, can = i[kept], j[kept], count[kept], groups[kept], plus[kept], can[:, kept]
        has = {c: x[kept] for c, x in has.items()}
        x, y, g = self.digits[i], self.digits[j], self.groups[j]
        held = lambda p, k: self.luhn[p][k][y] - self.luhn[p][k][x]
        luhn_ok = np.where((y - 1) % 2 == 0, held(0, 0) + held(1, 1), held(1, 0) + held(0, 1)) % 10 == 0
        last = [np.where(groups > k, self.sizes[np.maximum(g - 1 - k, 0)], 0) for k in range(4)] if len(self.sizes) else [g] * 4
        shape = lambda *sizes: (groups == len(sizes)) & np.all([last[len(sizes) - 1 - k] == s for k, s in enumerate(sizes)], 0)
        a, b = self.ends[i] - self.ends[0], self.ends[j] - self.ends[0] + 1  # of the character before, and after
        before, after, beyond = self.codes[a], self.codes[b], self.codes[b + 1]
        wordy = lambda c: c.isalnum() or c in "_@"
        among = lambda codes, marks: np.isin(codes, [ord(m) for m in marks])
        features = [
            np.ones(len(i)), luhn_ok, (count == 15) | (count == 16), (count >= 9) & (count <= 12), count > 12, plus,
            (has["("] > 0) & (has[")"] > 0), has["("] != has[")"], (has[" "] > 0) * 1 + (has["."] > 0) + (has["-"] > 0) <= 1, groups == 1,
            (self.ones[j] > self.ones[i]) & (groups > 3), shape(4, 4, 4, 4) | shape(4, 6, 5) | shape(16) | shape(15),
            (last[0] == 4) & (last[1] == 3) & (last[2] == 3), (last[0] == 4) & (last[1] == 3), (groups == 4) & (self.large[g] == self.large[self.groups[i]]),
            _told(before, wordy), _told(after, wordy), among(before, "+-.,"), among(after, "-/:%"),
            among(after, ".-@") & _told(beyond, str.isalnum), groups > 5, shape(4, 2, 2), np.zeros(len(i)),
        ]
        return i, j, can, np.array(features, float).T

    def mails(self, lo: int, hi: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Candidates with one @ that begin at tokens lo to hi: (first token, end token, features)."""
        text, ats = self.text, self.of["@"]
        near = np.flatnonzero(ats[np.minimum(np.arange(lo, hi) + MAX_TOKENS, self.n)] > ats[lo:hi]) + lo
        for i in near.tolist():
            a = int(self.ends[i])
            if not (text[a].isascii() and text[a].isalnum() or text[a] in "._%+-"):
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                b = int(self.ends[j])
                if b > self.stop[i] or ats[j] - ats[i] > 1 or text[b - 1].isspace():
                    break
                if ats[j] > ats[i] and MAIL.fullmatch(part := text[a:b]):
                    yield i, j, span_features(part, text[a - 1 : a] if a else "", text[b : b + 2])

    def candidates(self, lo: int, hi: int) -> list[tuple[int, int, int, np.ndarray]]:
        """(first token, end token, kind, features) by first token."""
        i, j, can, f = self.numbers(lo, hi)
        out = [(int(i[c]), int(j[c]), k + 1, f[c]) for k in range(3) for c in np.flatnonzero(can[k])]
        return sorted([*out, *((i, j, 0, f) for i, j, f in self.mails(lo, hi))], key=lambda x: x[:3])

    def weighed(self, lo: int, hi: int, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first token, end token, kind, score) by first token."""
        i, j, can, f = self.numbers(lo, hi)
        scores = f @ weights[1:].T
        kind, c = np.nonzero(can)
        out = list(zip(i[c].tolist(), j[c].tolist(), (kind + 1).tolist(), scores[c, kind].tolist(), strict=True))
        return sorted([*out, *((i, j, 0, float(weights[0] @ f)) for i, j, f in self.mails(lo, hi))])


def best_spans(text: str, start: int, end: int, taken: list[Span], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities, (kind, start, end); what is in none costs nothing."""
    s = Stretch(text, start, end, taken)
    value, back = [0.0] * (s.n + 1), [None] * (s.n + 1)
    done = 0

    def settle(upto: int) -> None:  # nothing that comes later ends here
        for x in range(done + 1, upto + 1):
            if value[x - 1] > value[x]:
                value[x], back[x] = value[x - 1], None

    for lo in range(0, s.n, BLOCK):
        for i, j, k, score in s.weighed(lo, min(s.n, lo + BLOCK), weights):
            settle(i)
            done = max(done, i)
            if (v := value[i] + score) > value[j]:
                value[j], back[j] = v, (i, k)
    settle(s.n)
    out, j = [], s.n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((k, int(s.ends[i]), int(s.ends[j])))
            j = i
    return out[::-1]


class Candidates:
    """A stretch's tokens and candidates, as training needs them."""

    def __init__(self, text: str):
        s = Stretch(text, 0, len(text), [])
        self.ends, self.found = s.ends.tolist(), s.candidates(0, s.n)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.array([weights[k] @ f for _, _, k, f in self.found])

    def gradient(self, weights: np.ndarray, truth: set[tuple[int, int, int]]) -> tuple[np.ndarray, float]:
        """Observed less expected features, and the log-likelihood of the truth, by forward and backward sums."""
        n, s = len(self.ends) - 1, self.scores(weights)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for c, (i, j, _, _) in enumerate(self.found):
            by_end.setdefault(j, []).append(c)
            by_start.setdefault(i, []).append(c)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[self.found[c][0]] + s[c] for c in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[self.found[c][1]] + s[c] for c in by_start.get(i, ()))])
        grad, likelihood = np.zeros_like(weights), -ahead[n]
        for c, (i, j, k, f) in enumerate(self.found):
            seen = (k, self.ends[i], self.ends[j]) in truth
            grad[k] += (seen - np.exp(ahead[i] + s[c] + behind[j] - ahead[n])) * f
            likelihood += seen * s[c]
        return grad, likelihood


def examples(count: int, seed: int) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Stretches of entities and of other numbers, with the entities' kinds and places."""
    pick = random.Random(seed)
    some = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    word = lambda: "".join(pick.choice("abcdefghiklmnoprst") for _ in range(pick.randint(2, 7)))

    def card() -> str:
        n = pick.choice([13, 15, 16, 16, 16, 16, 19])
        body = pick.choice("3456") + some(n - 2)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sep = pick.choice(["", "", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, n, 4)) if n == 16 else digits

    def phone() -> str:
        a, b, c = some(3), some(3), some(4)
        return pick.choice(
            [f"+1 ({a}) {b}-{c}", f"+{pick.randint(1, 99)} {a} {b} {c}", f"+{pick.randint(1, 99)}{a}{b}{c}",
             f"+{pick.randint(30, 49)} {some(2)} {some(4)} {some(4)}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}"]
        )

    def ip() -> str:
        return ".".join(str(pick.randint(0, 255)) for _ in range(4))

    def email() -> str:
        return f"{word()}{pick.choice(['', '.', '_'])}{pick.choice([word(), some(2)])}@{word()}{some(1)}.{word()}.{pick.choice(['com', 'org', 'net', 'de'])}"

    def other() -> str:
        while True:
            made = pick.choice(
                [some(pick.randint(1, 8)), some(10), some(pick.randint(13, 19)), f"{pick.randint(1900, 2030)}-{pick.randint(10, 12)}-{pick.randint(10, 28)}",
                 f"{pick.randint(1900, 2030)}-{pick.randint(1900, 2030)}", f"{some(1)}.{some(2)}.{some(1)}", f"{some(3)},{some(3)},{some(3)}",
                 f"{some(3)} {some(3)} {some(3)}", f"{some(4)}-{some(4)}", f"{some(3)}.{some(3)}.{some(3)}.{some(4)}", f"{some(2)}:{some(2)}:{some(2)}",
                 f"{word()}{some(3)}", f"v{some(1)}.{some(1)}.{some(1)}.{some(1)}.{some(1)}", f"{some(5)}-{some(4)}", f"{some(1)}-{some(5)}-{some(3)}-{some(1)}"]
            )
            d = digits_of(made)
            if not (13 <= len(d) <= 19 and luhn(d)):
                return made

    out = []
    for _ in range(count):
        text, truth = "", set()
        for _ in range(pick.randint(1, 3)):
            make = pick.choice([card, phone, ip, email, other, other, other])
            if text:
                text += " "
            elif pick.random() < 0.2:
                text = pick.choice(["(", "tel:", "#", "no.", "id="])
            made = make()
            if make is not other:
                truth.add((("email", "ip", "card", "phone").index(make.__name__), len(text), len(text) + len(made)))
            text += made
        if pick.random() < 0.3:
            text += pick.choice([".", ",", ")", ";", "%", "px", "/"])
        out.append((text, truth))
    return out


@functools.lru_cache(maxsize=4)
def train(seed: int = 5) -> np.ndarray:
    """(kinds, features) weights that make the examples' segmentations likeliest."""
    made = [(Candidates(t), truth) for t, truth in examples(EXAMPLES, seed)]
    made = [x for x in made if x[0].found]
    w = np.zeros((len(KINDS), FEATURES))
    w[:, 0] = -1
    total = np.full_like(w, 1e-6)
    order = random.Random(seed)
    for _ in range(EPOCHS):
        order.shuffle(made)
        for x, truth in made:
            g = x.gradient(w, truth)[0] - 1e-4 * w
            total += g * g
            w += RATE * g / np.sqrt(total)
    return w


def find(text: str, weights: np.ndarray) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans, and all spans, by kind."""
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    places = stretches(text)
    if not places:
        return base, every
    taken = sorted(x for v in base.values() for x in v)
    at = 0
    for start, end in places:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        upto = at
        while upto < len(taken) and taken[upto][0] < end:
            upto += 1
        mine = taken[at:upto]
        inside = text[start:end]
        if "@" not in inside and sum(map(inside.count, "0123456789")) < 4:  # no candidate has fewer digits
            continue
        if len(mine) == 1 and mine[0][0] <= start and end - mine[0][1] <= 2:
            continue
        for k, a, b in best_spans(text, start, end, mine, weights):
            every[KINDS[k]].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def shown(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """``text`` with its spans replaced by their kinds; overlapping ones by the first's."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", masked_to: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` as text and the numbers of base spans; ``masked_to``: a further
    column, the text with all spans replaced (null stays null). The text itself is left out on demand."""
    weights = train()
    schema = "base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text).to_pylist()
        found = [find(x, weights) if x else ({k: [] for k in KINDS},) * 2 for x in texts]
        out = {"base": [shown(b) for b, _ in found], "spans": [shown(s) for _, s in found]}
        out |= {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS}
        if masked_to:
            out[masked_to] = [masked(x, s) if x else x for x, (_, s) in zip(texts, found, strict=True)]
        return out

    return extend(docs, f"{schema}, `{masked_to}` string" if masked_to else schema, run, () if keep_text else (text,))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
