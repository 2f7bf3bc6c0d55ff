"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: an element node is a path of (tag, class, id) from the root, and holds
on how many pages it occurs, which sequences of children it has there (its presentation) and which texts (its
content). Presentation counts for more the more evenly its styles vary; a text counts for less the more pages show
it, as the entropy of its spread nears that of all pages. A node is low where both its measures are under ``LOW``
and it stands on half of the host's pages, which are ``MIN_PAGES`` at least; a branch of a page goes if its node and
all element nodes below are low.

Entropy can't tell a menu whose links differ from page to page from an article, so what HTML itself says is no article
goes first (nav, footer, aside, form, dialog, scripts, styles, a header outside of an article), and elements that
their own names call a menu, an advert, a notice or comments: a class or id whose last telling word is such a name
("main-ad", "social-links", but not "social-history"). Where a page marks its article, only that is read, and low
branches go from it too, but for headings without a name. If that took more than half of the article's text, copies of it
fill the host, and nothing goes from it.

Only the low nodes of a host meet its pages; each stands on half of them, so they are no more than twice the mean
number of nodes of a page, however large the host is. Where all hosts have at most ``MOST_LOW`` together they are
broadcast and html isn't shuffled; else pages are joined with them by host, the pages of large hosts in parts.

Defined results: null or empty html gives empty text; unclosed and badly nested elements end where HTML ends them;
unfinished tags at the end are dropped; pages without a host are one host; repeated rows count as pages each; other columns pass through, but those with an output's name give way.
"""

from __future__ import annotations

import hashlib
import html as markup
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import extend, map_batches, table, written

LOW, MIN_PAGES = 0.2, 4
#: Low nodes, and hosts that have any, that are broadcast at most.
MOST_LOW, MOST_HOSTS = 500_000, 100_000
#: Pages of one part of a large host; hosts that are dealt in parts, at most.
PART_PAGES, MOST_LARGE = 2000, 10_000
#: Rows of the tree that a worker gathers, and labels that it remembers, at most.
MAX_ROWS, MAX_KEYS = 50_000, 50_000

# Groups of HTML elements, and names of branches that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option button svg math iframe object canvas audio video head title".split())
UNREAD = frozenset("script style textarea title iframe noscript".split())
CUT = RAW | frozenset("nav header footer aside form menu dialog fieldset label".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies disclaimer discussion disqus footer form gdpr header hidden login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related "
    "replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar "
    "topbar trending widget widgets".split()
)
#: Words that say only what form the thing before them has.
FORMS = frozenset("area bar block body bottom box btn button buttons center col column container content group holder inner item items left link links list nav outer panel posts right row section text top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_keys: dict[tuple[int, str], int] = {}


def _key(parent: int, label: str) -> int:
    found = _keys.get((parent, label))
    if found is None:
        found = _hash(f"{parent} {label}")
        if len(label) < 64:
            if len(_keys) >= MAX_KEYS:
                _keys.clear()
            _keys[parent, label] = found
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _telling(names: str) -> bool:
    """Whether the last telling word of any of the names is that of a branch that is no article."""
    for name in names.split():
        words = [w.lower() for w in NAME_PART.findall(name)]
        while len(words) > 1 and (words[-1] in FORMS or words[-1].isdigit() or len(words[-1]) == 1):
            words.pop()
        if words and words[-1] in NAMES:
            return True
    return False


class Page:
    """Elements in page order with their parents, and the pieces of text and block edges between them."""

    def __init__(self, html: str):
        self.tag, self.parent, self.key, self.named, self.noise = ["#"], [0], [0], [False], [False]
        self.parts: list[tuple[int, str | None]] = []  # (element, text; None at a block's edge)
        self.open: Counter[str] = Counter()  # elements on the stack, by tag
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # and where on the stack they are
        self.blocks: list[int] = []  # places of open blocks
        stack, at, n = [0], 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                self._text(stack[-1], html[at:])
                break
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            self._imply(stack, name)
            self._open(stack, name, m[3] or m[6] or "")
            if name in UNREAD:
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
                at = end.start() if end else n
            if name in VOID or (m[3] or m[6] or "").endswith("/") and name in ("svg", "path"):
                self._end(stack, len(stack) - 1)

    def _text(self, element: int, text: str) -> None:
        self.parts.append((element, text))

    def _open(self, stack: list[int], name: str, rest: str) -> None:
        names, role = "", ""
        if rest and "=" in rest:
            for a, x, y, z in ATTRIBUTE.findall(rest):
                value = x or y or z
                if a.lower() == "role":
                    role = value.lower()
                else:
                    names += f" {value}"
        label = f"{name} {' '.join(names.split())}" if names else name
        self.tag.append("main" if role == "main" else name)
        self.parent.append(stack[-1])
        self.key.append(_key(self.key[stack[-1]], label))
        self.named.append(bool(names.strip()))
        titled = (name == "header" or role == "banner") and (self.open["article"] or self.open["main"])  # an article's own
        noise = (name in CUT or role in ROLES) and not titled
        self.noise.append(bool(noise or names and name not in ("html", "body", "main", "article") and _telling(names)))
        self.open[self.tag[-1]] += 1
        self.places[self.tag[-1]].append(len(stack))
        if self.tag[-1] in BLOCK:
            self.blocks.append(len(stack))
        stack.append(len(self.tag) - 1)
        if name in BLOCK:
            self.parts.append((stack[-1], None))
        elif name == "br":
            self.parts.append((stack[-1], " "))

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        depth = len(stack) - 1
        while self.tag[stack[depth]] != name:  # what is passed here ends with it
            depth -= 1
        if name in BLOCK or any(self.tag[i] in BLOCK for i in stack[depth:]):
            self.parts.append((stack[depth], None))
        self._end(stack, depth)

    def _end(self, stack: list[int], depth: int) -> None:
        for i in stack[depth:]:
            self.open[self.tag[i]] -= 1
            self.places[self.tag[i]].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        del stack[depth:]

    def _imply(self, stack: list[int], name: str) -> None:
        """Ends what the start of ``name`` ends: an open paragraph, an item before its next."""
        if name in BLOCK and name not in ("html", "body") and self.blocks and self.tag[stack[self.blocks[-1]]] == "p":
            self._cut(stack, self.blocks[-1])
        if name in CLOSES:
            last = lambda tags: max((self.places[t][-1] for t in tags if self.open[t]), default=0)
            if (depth := last(CLOSES[name])) > last(STOPS[name]):
                self._cut(stack, depth)

    def _cut(self, stack: list[int], depth: int) -> None:
        self.parts.append((stack[depth], None))
        self._end(stack, depth)

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """(node, kind, feature): kind 0 the node itself, 1 its style, 2 a text that stands in it."""
        cut = [False] * len(self.tag)
        styles: dict[int, list[str]] = {}
        for i in range(1, len(self.tag)):
            cut[i] = cut[self.parent[i]] or self.noise[i]
            if not cut[i]:
                yield self.key[i], 0, 0
                sequence = styles.setdefault(self.parent[i], [])
                if not sequence or sequence[-1] != self.tag[i]:  # any number of one kind is one style
                    sequence.append(self.tag[i])
        for i in range(1, len(self.tag)):
            if not cut[i]:
                yield self.key[i], 1, _key(1, " ".join(styles.get(i, ())))
        for i, text in self.parts:
            if text and not cut[i] and i and not text.isspace():
                yield self.key[i], 2, _hash(" ".join(text.split()))

    def main_text(self, low: frozenset[int] | set[int] = frozenset()) -> str:
        n = len(self.tag)
        marked = [t in ("article", "main") for t in self.tag]
        for i in range(1, n):
            marked[i] = marked[i] and not self.noise[i] or marked[self.parent[i]]
        plain = self._kept([False] * n)
        whole = not any(map(operator.and_, marked, plain))
        branch = [k in low for k in self.key]
        for i in range(n - 1, 0, -1):
            if not branch[i]:
                branch[self.parent[i]] = False
        if any(branch):
            heading = lambda i: not whole and marked[i] and self.tag[i] in HEADINGS and not self.named[i]
            judged = self._kept([b and self.tag[i] in BLOCK and not heading(i) for i, b in enumerate(branch)])
            size = lambda kept: sum(len(t) for i, t in self.parts if t and kept[i] and (whole or marked[i]) and not t.isspace())
            if whole or 2 * size(judged) >= size(plain):
                plain = judged
        blocks, held = [], []
        for i, text in [*self.parts, (0, None)]:
            if text is None:
                if held and (block := " ".join(markup.unescape("".join(held)).split())):
                    blocks.append(block)
                held = []
            elif plain[i] and (whole or marked[i]):
                held.append(text)
        return "\n\n".join(blocks)

    def _kept(self, low: list[bool]) -> list[bool]:
        """Elements that are neither noise or low nor inside such a one."""
        kept = [True] * len(self.tag)
        for i in range(1, len(kept)):
            kept[i] = kept[self.parent[i]] and not self.noise[i] and not low[i]
        return kept


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(found, F.lit(""))


def style_tree(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The merged trees: (host, node, kind, feature, pages), hosts by their hash; added up in each task before they are
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count: dict[tuple, int] = {}

        def out() -> dict:
            columns = zip(*((*k, v) for k, v in count.items()), strict=True) if count else [()] * 5
            return dict(zip(("host", "node", "kind", "feature", "pages"), map(list, columns), strict=True))

        for batch in batches:
            for host, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in {(0, 0, 0), *Page(x or "").nodes()}:
                    count[(host, *node)] = count.get((host, *node), 0) + 1
                if len(count) > MAX_ROWS:
                    yield out()
                    count = {}
        yield out()

    schema = T._parse_datatype_string("host long, node long, kind int, feature long, pages long")
    made = map_batches(pages.select(F.xxhash64(host_of(F.col(f"`{url}`"))).alias("host"), F.col(f"`{html}`").alias("html")), schema, run)
    return made.groupBy("host", "node", "kind", "feature").agg(F.sum("pages").alias("pages"))


def low_nodes(tree: DataFrame) -> DataFrame:
    """(host, low): each host's nodes of low importance."""
    of_kind = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    ln = F.log(F.col("pages").cast("double"))
    node = tree.groupBy("host", "node").agg(
        of_kind(0, F.col("pages")).alias("m"),
        of_kind(1, F.col("pages") * ln).alias("styles"),
        of_kind(2, F.col("pages")).alias("texts"),
        of_kind(2, F.col("pages") * ln).alias("spread"),
    )
    everywhere = node.filter("node = 0").select("host", F.col("m").alias("all"))
    log_m = F.log(F.col("m").cast("double"))
    judged = node.filter(f"node <> 0 AND m >= {MIN_PAGES}").select(
        "host", "node", "m",
        (1 - F.coalesce(F.col("styles"), F.lit(0.0)) / (F.col("m") * log_m)).alias("presentation"),
        F.when(F.col("texts") > 0, 1 - F.col("spread") / (F.col("texts") * log_m)).otherwise(0.0).alias("content"),
    )
    low = judged.filter((F.col("presentation") < LOW) & (F.col("content") < LOW)).join(everywhere, "host").filter("2 * m >= all")
    return low.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low"))


def _in_parts(pages: DataFrame, host: Column, low: DataFrame) -> DataFrame:
    """``pages`` with their hosts' low nodes as ``__low``. Hosts with a ten-thousandth of all pages or more, which are
    ``MOST_LARGE`` at most, are dealt in parts."""
    count = pages.groupBy(host.alias("__host")).agg(F.count("*").alias("n"))
    large = written(count.filter(f"n > {PART_PAGES}").select("__host", "n"), "large")
    least = F.lit(pages.count() / MOST_LARGE)
    large = F.broadcast(large.filter(F.col("n") >= least).select("__host", F.ceil(F.col("n") / PART_PAGES).cast("int").alias("__parts")))
    parts = low.select(F.col("host").alias("__host"), F.col("low").alias("__low")).join(large, "__host", "left")
    parts = parts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    dealt = pages.withColumn("__host", host).join(large, "__host", "left")
    dealt = dealt.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    return dealt.join(parts, ["__host", "__part"], "left").drop("__part")


def extract_main_text(
    pages: DataFrame, html: str = "html", url: str = "url", text: str = "text", most_low: int = MOST_LOW, keep_html: bool = True
) -> DataFrame:
    """``pages`` with the main text of their whole html, which is left out on demand. Up to ``most_low`` low nodes of all
    hosts are broadcast."""
    low = written(low_nodes(style_tree(pages, html, url)), "low-nodes")
    size = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("nodes"), F.count("*").alias("hosts")).first()
    host = F.xxhash64(host_of(F.col(f"`{url}`")))
    if size.nodes <= most_low and size.hosts <= MOST_HOSTS:
        found = {r.host: np.array(r.low, np.int64) for r in low.collect()}  # within the bounds just checked
        shared = pages.sparkSession.sparkContext.broadcast(found)

        def low_of(batch: pa.RecordBatch, i: int, h: int) -> list[int]:
            return shared.value.get(h, np.zeros(0, np.int64)).tolist()

        judged = pages.withColumn("__host", host)
    else:
        judged = _in_parts(pages, host, low)

        def low_of(batch: pa.RecordBatch, i: int, h: int) -> list[int]:
            return batch.column("__low")[i].as_py() or []

    def run(batch: pa.RecordBatch) -> dict:
        made, last, held = [], None, frozenset()
        for i, (h, x) in enumerate(zip(batch.column("__host").to_pylist(), batch.column(html).to_pylist(), strict=True)):
            if h != last:
                last, held = h, frozenset(low_of(batch, i, h))
            made.append(Page(x).main_text(held) if x else "")
        return {text: made}

    return extend(judged, f"`{text}` string", run, ("__low", "__host", *(() if keep_html else (html,))))


def op2_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, keep_html=False).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
