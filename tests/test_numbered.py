import time

from factloom.functions import markup as M
from factloom.sources import adapters as A
from factloom.sources import numbered as N


def test_numbers_hold_over_many_splits(spark, tmp_path):
    lines = [f"name {i},{i}" if i % 50 else f"name {i},{i},more" for i in range(4000)]
    for name, own in (("a", lines), ("b", lines[:7])):
        (tmp_path / f"{name}.csv").write_text("﻿Legal,Key\n" + "\n".join(x + "\n" * (i % 3 == 0) for i, x in enumerate(own)) + "\n", encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "4096")
        found = N.read_numbered(spark, str(tmp_path))
        assert found.rows.select("file").distinct().count() == 2 and found.rows.rdd.getNumPartitions() > 0
        got = {(r.file[-5:], r.row): r.Key for r in found.rows.collect()}
        bad = {(r.file[-5:], r.row): r.line for r in found.rejects.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(f"{f}.csv", i): str(i) for f, n in (("a", 4000), ("b", 7)) for i in range(n) if i % 50}
    assert bad == {(f"{f}.csv", i): f"name {i},{i},more" for f, n in (("a", 4000), ("b", 7)) for i in range(0, n, 50)}
    records = A.custom_records(found.rows, {"Legal": "legal_name"}, "row")
    assert {r.external_ref for r in records.collect()} == {f"row-{i}" for i in range(4000) if i % 50}


def test_selectors_read_marks_as_html_has_them():
    html = "<DIV Class='a &amp; b x'>one<script>if (a<b) '</p>'</script><p title=\"a>b\">two &eacute;<br/>three</p></div><p/>four<!-- <p>no</p> --><p>five"
    found = lambda *s: M.texts(html, [M.css(x) for x in s])
    assert found("div.x > p::text", "div p", "p::attr(title)") == [["two é", "three"], ["two éthree"], ["a>b"]]
    assert found("script", "div.x")[0] == ["if (a<b) '</p>'"] and found("p::text")[0][-1] == "five"


def test_references_end_in_a_semicolon():
    html = '<h1>a&amp;&amp;lt; &#233;&#xE9;&nope;&ampx; b&amp</h1><a href="?x=1&copy=2&amp;y">l</a>'
    assert M.texts(html, [M.css("h1::text"), M.css("a::attr(href)")]) == [["a&&lt; éé&nope;&ampx; b&amp"], ["?x=1&copy=2&y"]]


def test_selectors_are_linear_in_a_page():
    for piece in ("<i>x</b>", "<p>a<b>", "<div class=x><i>t", "<a href='x"):
        began = time.thread_time()
        M.texts(piece * (1_000_000 // len(piece)), [M.css("div.x b::text"), M.css("title"), M.css("div.x")])
        assert time.thread_time() - began < 12, piece
