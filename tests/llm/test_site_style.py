import html as markup
import math
import re

from factloom.llm import site_style as S

SCHEMA = "page_id long, url string, html string, text string"
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><p>Top</p></header><nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div>
<div class="x9"><p>Follow us everywhere</p></div><!-- ad --><div id="main-ad">Buy {i}</div>
<div class="content"><h1>Title&nbsp;{i} &amp; more</h1><p>First  para {i}<br>line two<p>Second <b>bold {i}</b> tail &lt;3
<ul><li>one {i}<li>two {i}</ul></div><aside>Side</aside><form>Name <input></form>
<section class="comments"><p>nice {i}</p></section><footer>&copy; {i}</footer></body></html>"""


def _pages(spark, count, url="http://a.example/{i}"):
    return spark.createDataFrame([(i, url.format(i=i), PAGE.format(i=i), "clash") for i in range(count)], SCHEMA)


def test_low_branches_go_and_the_article_stays(spark):
    for count in (8, 1):
        for r in S.extract_main_text(_pages(spark, count)).collect():
            i = r.page_id
            want = [f"Title {i} & more", f"First para {i} line two", f"Second bold {i} tail <3", f"one {i}", f"two {i}"]
            # one page alone doesn't show that a box stands on every page
            assert r.text == "\n\n".join(([] if count > 1 else ["Follow us everywhere"]) + want)


def test_importance_is_that_of_the_definition(spark):
    rows = [(0, "http://h/1", "<body><div>same</div><p>a</p></body>"), (1, "http://h/2", "<body><div>same</div><p>b</p></body>"),
            (2, "http://h/3", "<body><div>same</div><p>c</p></body>"), (3, "http://h/4", "<body><div>same</div><p>a</p></body>")]
    tree = S.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    pages = [S.Page(h) for _, _, h in rows]
    key = {t: pages[0].key[i] for i, t in enumerate(pages[0].tag)}
    count = {(r.node, r.kind): sorted(x.pages for x in tree if (x.node, x.kind) == (r.node, r.kind)) for r in tree}
    assert count[0, 0] == [4] and count[key["div"], 2] == [4] and count[key["p"], 2] == [1, 1, 2]
    low = S.low_nodes(spark.createDataFrame(tree, "host string, node long, kind int, feature long, pages long")).first()
    assert set(low.low) == {key["body"], key["div"]}
    content = 1 - 2 * math.log(2) / (4 * math.log(4))
    assert content > S.LOW  # of p


def test_copies_of_an_article_on_one_host_stay(spark):
    page = "<body><nav>m</nav><article><h1>T</h1><p>Same text.</p></article><footer>f</footer></body>"
    rows = [(i, "http://a/x", page, "") for i in range(9)]
    assert {r.text for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"T\n\nSame text."}


def test_query_reads_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    out = S.op2_site_style(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(pages)
    for r in out:  # these pages have one article each, of a heading and paragraphs
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(markup.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    texts = [None, "", "plain", "<p>a<p>b", "a < b > c", "<p>x</p", "<div", "<script>never", "<a href='x>y'>z</a>", deep, "<p>&amp;lt; &#65;</p>", "<b><p>q</b>r"]
    rows = [(i, None if i % 2 else "no url", t, "") for i, t in enumerate(texts)] + [(3, "no url", "<p>a<p>b", "")]
    out = S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.page_id: r.text for r in out}
    want = ["", "", "plain", "a\n\nb", "a < b > c", "x", "", "", "z", "x", "&lt; A", "q\n\nr"]
    assert len(out) == len(rows) and got == dict(enumerate(want))
    assert S.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_end_tag_finds_its_element_at_any_depth():
    for count in (10, 399, 400, 5000):
        menu = "<a href='x'>m" * count
        assert S.Page(f"<body><div class='menu'>{menu}</div><p>Text.</p></body>").main_text() == "Text."
        assert S.Page(f"<body><article><p>Text.</p><i>{'<b>' * count}</article><p>nice</p></body>").main_text() == "Text."
    page = S.Page("<ul>" + "<li><b>x" * 3000 + "<br></q></ul>" + "</b>" * 3000 + "<p>end")
    assert dict(+page.open) == {"p": 1}


ANONYMOUS = """<html><body><div><div><div><a href="/">Home</a> <a href="/x">All stories</a></div><div><p>{article}</p><p>{more}</p></div>
<div><div>Read this every day</div></div></div><table><tr><td>Imprint and terms</td></tr></table></div></body></html>"""


def test_the_tree_decides_where_nothing_else_tells(spark):
    rows = [(i, f"http://a.example/{i}", ANONYMOUS.format(article=f"Story {i}", more=f"End of {i * 7}"), "") for i in range(12)]
    with_tree = S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in with_tree:
        assert r.text == f"Story {r.page_id}\n\nEnd of {r.page_id * 7}"
        alone = S.Page(r.html).main_text()
        assert alone == f"Home All stories\n\nStory {r.page_id}\n\nEnd of {r.page_id * 7}\n\nRead this every day\n\nImprint and terms"
    joined = S.extract_main_text(spark.createDataFrame(rows, SCHEMA), most_low=0).collect()
    assert sorted(joined) == sorted(with_tree)


def test_the_tree_cuts_inside_a_marked_article_too(spark):
    page = "<body><article><h1>T</h1><p>Long story {i} of many words.</p><div><div>Rate it</div></div></article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i), "") for i in range(6)]
    assert {r.text for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {f"T\n\nLong story {i} of many words." for i in range(6)}


def test_names_that_only_contain_a_telling_word():
    for name in ("post search-results-story", "social-history", "share-price-report", "navigation-history-essay"):
        assert S.Page(f"<body><div class='{name}'><p>Body text</p></div></body>").main_text() == "Body text"
    assert S.Page("<article><header><h1>Title</h1></header><p>a</p><section id='social-history'><p>b</p></section></article>").main_text() == "Title\n\na\n\nb"
    for name in ("main-ad", "social-links", "cookie-notice", "comment-list", "sidebar-left", "ad-300x250", "newsletterSignup"):
        assert S.Page(f"<body><div class='{name}'><p>Noise</p></div><p>Text</p></body>").main_text() == "Text"
    deep = "<div>" * 600 + "<article><p>Deep</p></article><div class='comments'>no</div>" + "</div>" * 600
    assert S.Page(f"<body>{deep}</body>").main_text() == "Deep"


def test_large_hosts_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_PAGES", 3)
    rows = [(i, f"http://{'a' if i % 3 else 'b' * (i % 7)}.example/", ANONYMOUS.format(article=f"Story {i}", more="x"), "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(S.extract_main_text(df, most_low=0).collect()) == sorted(S.extract_main_text(df).collect())


def test_a_very_long_page_and_ties(spark):
    long = "<p>" + "word " * 400_000 + "</p>" + "<p>a" * 20_000
    rows = [(1, "http://a/", f"<body>{long}</body>", ""), (2, "http://a/", None, ""), (2, "http://a/", None, "")]
    out = {r.page_id: r.text for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2] == "" and len(out[1]) == len("word " * 400_000) - 1 + 3 * 20_000


def test_pages_of_unclosed_elements_are_read_in_linear_time():
    import time

    for piece, text in (("<b><p>word ", "word"), ("<i><td>cell ", "cell"), ("<span><li>item ", "item"), ("<article><aside><i>x", "")):
        html = piece * (1_000_000 // len(piece))
        began = time.thread_time()
        page = S.Page(html)
        found = page.main_text()
        list(page.nodes())
        assert time.thread_time() - began < 12, piece
        assert found.split("\n\n")[:3] == [text] * 3 if text else found == ""
