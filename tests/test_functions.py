import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text, values


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("function", "value", "want"), [
    (text.normalize_company_name, "ABC Industries Pvt. Ltd.", "abc industries"), (text.normalize_company_name, "ABC INDUSTRIES PRIVATE LIMITED", "abc industries"),
    (text.normalize_company_name, "Sunrise Metals & Alloys LLP", "sunrise metals alloys"), (text.normalize_company_name, "  Extra   Space   Corp  ", "extra space"),
    (text.normalize_company_name, "Limited", "limited"), (text.normalize_company_name, "Café Zoë Inc", "café zoë"), (text.normalize_company_name, None, ""),
    (text.strip_legal_suffix, "Co Co", "Co"), (text.normalize_domain, "https://www.Example.com:80/about?x", "example.com"), (text.normalize_domain, "Example.org", "example.org"),
    (text.normalize_domain, " ", None), (text.normalize_domain, "https://u:p@Host.example/", "host.example"), (text.extract_postal_code, "Plot 1234567, Pune 411019, India", "411019"),
    (text.extract_postal_code, "no code 12345", None), (text.email_domain, "a@b@C.Example", "c.example"), (text.email_domain, "none", None),
    (text.title_case, "o'brien tamil-nadu élan", "O'Brien Tamil-Nadu Élan"), (text.identifier, " ab1 ", "AB1"), (text.comma_list, "a, b,, c ", ["a", "b", "c"]),
    (text.external_key, " Company_Status (for efiling)", "COMPANY_STATUS"), (text.scrub_secrets, "x?api-key=REAL&y 'X-Api-Key': 'abc' token: zz", "x?api-key=***&y 'X-Api-Key=***' token=***"),
    (text.valid_cin, "U12345MH2001PTC123456", True), (text.valid_cin, "U12345", False), (text.safe_url, "https://example.com/x", True), (text.safe_url, "http://10.1.2.3/", False),
    (text.safe_url, "file:///etc", False), (text.safe_url, "https://a:b@example.com", False), (values.clean_number, " 1,234.5 ", "1234.5"), (values.clean_number, "-1", None),
    (values.clean_number, "1.2.3", None), (values.flexible_date, "05-03-2020", datetime.date(2020, 3, 5)), (values.flexible_date, "5/3/2020", datetime.date(2020, 3, 5)),
    (values.flexible_date, "2020-02-30", None), (values.safe_int, "12.9", 12), (values.safe_int, "x", None), (values.safe_bool, " YES ", True), (values.safe_bool, "maybe", None),
    (values.safe_date, "2020-01-02", datetime.date(2020, 1, 2)),
])
def test_values(spark, function, value, want):
    assert one(spark, function, value) == want


@pytest.mark.parametrize(("value", "want"), [("34", (34, 34, 34)), ("50-200 employees", (None, 50, 200)), ("200 to 50", (None, 50, 200)), ("1000+ employees", (None, 1000, None)), ("~1,234", (1234,) * 3)])
def test_employee_ranges(spark, value, want):
    assert tuple(one(spark, values.employee_range, value)) == want


@pytest.mark.parametrize(("value", "want"), [
    ("₹10 crore", (1e8, None, None)), ("Rs. 1.2 lakh", (1.2e5, None, None)), ("128000000", (1.28e8, None, None)), ("10-50 crore", (None, 1e8, 5e8)), ("10 to 50 crore", (None, 1e8, 5e8)),
])
def test_revenue(spark, value, want):
    assert tuple(one(spark, values.inr_revenue, value)) == want


def test_nothing_to_parse(spark):
    assert one(spark, values.inr_revenue, ",") is None and one(spark, values.employee_range, "many") is None and one(spark, values.inr_revenue, None) is None


def _indel(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if not a or not b:
        return 0.0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b))


def test_similarities(spark):
    names = ["abc industries", "abc industris", "industries abc", "kitten", "sitting", "", "x", "new delhi tea & co"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in df.select("a", "b", text.token_sort_similarity(F.col("a"), F.col("b")).alias("s"), text.trigram_similarity(F.col("a"), F.col("b")).alias("t")).collect():
        assert abs(r.s - _indel(r.a, r.b)) < 1e-12
        x, y = text.python_trigrams(r.a), text.python_trigrams(r.b)
        assert abs(r.t - (len(x & y) / len(x | y) if x | y else 0.0)) < 1e-12


def test_formats(spark):
    rows = [(None,), (12_345_678.0,), (250_000.0,), (999.0,)]
    assert [r.y for r in spark.createDataFrame(rows, "x double").select(values.format_inr(F.col("x")).alias("y")).collect()] == ["Unknown", "₹1.23 Cr", "₹2.50 L", "₹999"]
    assert one(spark, values.confidence_label, 0.4, "double") == "medium"


def test_token_sort_similarity_of_long_and_short_texts(spark):
    pick = random.Random(9)
    letters = lambda n: "".join(pick.choice("ab cé") for _ in range(n))
    rows = [(letters(pick.randint(0, 20)), letters(pick.randint(0, 20))) for _ in range(40)] + [(letters(a), letters(b)) for a, b in ((62, 90), (63, 64), (120, 61), (90, 90))] + [(None, "a"), ("", "")]

    def of(a, b):
        x, y = (" ".join(sorted((s or "").split())) for s in (a, b))
        if not x or not y:
            return 0.0
        row = [0] * (len(y) + 1)
        for c in x:
            row = [0, *_next(row, c, y)]
        return 2.0 * row[-1] / (len(x) + len(y))

    def _next(above, c, y):
        left = 0
        for j, d in enumerate(y):
            left = above[j] + 1 if c == d else max(left, above[j + 1])
            yield left

    got = spark.createDataFrame(rows, "a string, b string").select(text.token_sort_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in got] == [round(of(a, b), 9) for a, b in rows]
