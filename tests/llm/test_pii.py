import hashlib
import re
import time

from factloom.llm import pii as P

SCHEMA = "doc_id long, text string, spans string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _plain(text):
    """The patterns as they stand in the contract."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and P.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


ODD = [
    "", "a@b.c@d.e.f", "@x.y", "a@.b", "x@y-.z. q@r.s", "1.2.3.4.5.6.7.8", "1.2.3.256 300.1.1.1", "00000255.1.1.0001", "é4111 1111-1111 1111é",
    "4111111111111111 4111111111111111", "+1 (269) 555-3296 4524132264652876", "+1-----", "+49 30 1234 5678.", "a@b.co+4912345678901", "..a@b.c", "1.2.3", "\n+1\n2 3",
]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in texts:
        assert P.base_spans(text) == _plain(text), text


def test_very_long_runs_of_digits():
    for zeros, ends in (("0" * 5_000, [(0, 5_006)]), ("7" * 5_000, [])):
        base, every = P.find(f"{zeros}.1.1.1", P.train())
        assert base["ip"] == ends and every["ip"][: len(ends)] == ends


def test_a_megabyte_takes_seconds():
    weights = P.train()
    mails = "some.one@mail.example.org " * 40_000
    texts = [mails, mails.replace(" ", " 12 "), mails.replace(" ", " x "), "7" * 1_000_000, "a1." * 333_000, "x@" * 500_000, "10.20.30.40:80 " * 70_000]
    for text in texts:
        began = time.process_time()
        base, _ = P.find(text, weights)
        assert time.process_time() - began < 20
    assert len(P.find(mails, weights)[0]["email"]) == 40_000


def test_held_out_stretches():
    weights, right = P.train(), 0
    made = P.examples(400, 77)
    for text, truth in made:
        right += set(P.best_spans(text, 0, len(text), [], weights)) == truth
    assert right / len(made) > 0.9


def test_best_segmentation_is_the_best_of_all():
    weights = P.train()
    for text, _ in P.examples(60, 13):
        c = P.Candidates(text)
        scores = c.scores(weights)

        def every(at, c=c):
            yield 0.0
            for n, (i, j, _, _) in enumerate(c.found):
                if i >= at:
                    for rest in every(j):
                        yield scores[n] + rest  # noqa: B023

        if len(c.found) > 40:
            continue
        index = {(k, c.ends[i], c.ends[j]): s for (i, j, k, _), s in zip(c.found, scores, strict=True)}
        assert abs(max(every(0)) - sum(index[x] for x in P.best_spans(text, 0, len(text), [], weights))) < 1e-9


def test_adds_what_runs_together_and_leaves_numbers_alone():
    w = P.train()
    base, every = P.find("call +1 (269) 555-3296 4524132264652876 now", w)
    assert not any(base.values()) and every["phone"] == [(5, 22)] and every["card"] == [(23, 39)]
    assert P.masked("call +1 (269) 555-3296 4524132264652876 now", every) == "call <PHONE> <CARD> now"
    for text in ("on 2024-01-15 at 10:30", "pages 1995-2001", "v1.2.3 of 2020", "total 1,234,567", "12345678", "12"):
        assert not any(v for s in P.find(text, w) for v in s.values())


def test_query_and_odd_rows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in P.op3_pii(spark, "/root/testdata/sf0.001").collect():
        want = _plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in P.KINDS)
        assert r.base_sha256 == hashlib.sha256(P.shown(want).encode()).hexdigest()
        assert set(P.shown(want).split(",")) - {""} <= set(r.spans.split(","))
    long = "9" * 200_000 + " " + "1 " * 20_000 + "a@b.cd"
    rows = [(1, None, "clash"), (2, "", ""), (3, long, ""), (4, "x@y.zz", ""), (4, "x@y.zz", "")]
    out = P.find_pii(spark.createDataFrame(rows, SCHEMA), masked_to="clean").collect()
    got = [(r.doc_id, r.spans, r.clean) for r in out if r.doc_id != 3]
    assert got == [(1, "", None), (2, "", ""), (4, "email:0:6", "<EMAIL>"), (4, "email:0:6", "<EMAIL>")]
    assert P.find_pii(spark.createDataFrame([], SCHEMA)).count() == 0
