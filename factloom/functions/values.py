"""Numbers, ranges, dates and casts as Columns (NUM-*, DAT-*, MAP-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip_all

# Names of amounts, and the words for true and false.
UNITS = {
    "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000,
    "million": 1_000_000, "mn": 1_000_000, "m": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000, "thousand": 1_000, "k": 1_000,
}
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")
WHOLE = r"(\d[\d,]*)"
AMOUNT = r"([\d,]*\d[\d,]*(?:\.\d+)?)"
UNIT = r"(crores?|cr|lakhs?|lacs?|million|mn|m|billion|bn|thousand|k)"
BETWEEN = r"\s*[-to]{1,3}\s*"


def clean_number(x: Column) -> Column:
    """NUM-01: digits and at most one point, without commas; anything else is null."""
    bare = strip_all(F.replace(x, F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^(?=.*\d)\d*\.?\d*$"), bare)


def _whole(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")


def employee_range(x: Column) -> Column:
    """NUM-02: struct(count, range_min, range_max) of '34', '50-200 employees' or '1000+'; null if there is no number."""
    pair = WHOLE + BETWEEN + WHOLE
    low, high = _whole(F.regexp_extract(x, pair, 1)), _whole(F.regexp_extract(x, pair, 2))
    more, one = _whole(F.regexp_extract(x, WHOLE + r"\s*\+", 1)), _whole(F.regexp_extract(x, WHOLE, 1))
    none = F.lit(None).cast("bigint")

    def made(count: Column, least: Column, most: Column) -> Column:
        return F.struct(count.alias("count"), least.alias("range_min"), most.alias("range_max"))

    return (
        F.when(x.rlike(pair), made(none, F.least(low, high), F.greatest(low, high)))
        .when(x.rlike(WHOLE + r"\s*\+"), made(none, more, none))
        .when(x.rlike(WHOLE), made(one, one, one))
    )


def inr_revenue(x: Column) -> Column:
    """NUM-03: struct(value_inr, range_min_inr, range_max_inr); the last unit in the text holds for both ends of a range.

    A number needs a digit (a lone comma is none)."""
    text = F.lower(x)
    pair = AMOUNT + r"\s*" + UNIT + "?" + BETWEEN + AMOUNT
    single = AMOUNT + r"\s*" + UNIT + "?"
    amount = lambda pattern, i: F.replace(F.regexp_extract(text, pattern, i), F.lit(","), F.lit("")).try_cast("double")
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(1))
    shared = _multiplier(F.get(units, F.size(units) - 1))
    low, high = amount(pair, 1) * shared, amount(pair, 3) * shared
    value = amount(single, 1) * _multiplier(F.regexp_extract(text, single, 2))
    none = F.lit(None).cast("double")

    def made(exact: Column, least: Column, most: Column) -> Column:
        return F.struct(exact.alias("value_inr"), least.alias("range_min_inr"), most.alias("range_max_inr"))

    return F.when(text.rlike(pair), made(none, F.least(low, high), F.greatest(low, high))).when(text.rlike(single), made(value, none, none))


def _multiplier(unit: Column) -> Column:
    """One look-up in a constant map."""
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(unit, F.lit(""))), F.lit(1))


def flexible_date(x: Column) -> Column:
    """DAT-01: the first of year-month-day, day-month-year with dashes or with slashes."""
    bare = strip_all(x)
    return F.coalesce(*(F.try_to_date(bare, f) for f in ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy")))


def safe_int(x: Column) -> Column:
    """NUM-04: by way of a float, towards zero; what isn't one is null."""
    return x.try_cast("double").try_cast("int")


def safe_float(x: Column) -> Column:
    return x.try_cast("double")


def safe_bool(x: Column) -> Column:
    word = F.lower(strip_all(x))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def safe_date(x: Column) -> Column:
    return F.try_to_date(x, "yyyy-MM-dd")


def clamp01(x: Column) -> Column:
    """NUM-06."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def age_days(now: Column, then: Column) -> Column:
    """DAT-03."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(now) - micros(then)) / 86_400_000_000.0


def matches_type(x: Column, kind: str) -> Column:
    """MAP-05: blank, or a value of the type."""
    blank = F.coalesce(strip_all(x) == "", F.lit(True))
    if kind == "number":
        return blank | clean_number(x).isNotNull()
    if kind == "date":
        return blank | flexible_date(x).isNotNull()
    if kind == "boolean":
        return blank | F.lower(strip_all(x)).isin(*TRUE_WORDS, *FALSE_WORDS)
    return F.lit(True)


def format_inr(x: Column) -> Column:
    """PRJ-08: crore and lakh; what is below keeps its digits."""
    fixed = lambda n: F.format_string("%.2f", x / n)
    return (
        F.when(x.isNull(), "Unknown")
        .when(x >= 10_000_000, F.concat(F.lit("₹"), fixed(1e7), F.lit(" Cr")))
        .when(x >= 100_000, F.concat(F.lit("₹"), fixed(1e5), F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), F.round(x).cast("bigint").cast("string")))
    )


def format_employees(count: Column, least: Column, most: Column) -> Column:
    """PRJ-08."""
    return (
        F.when(count.isNotNull(), count.cast("string"))
        .when(least.isNotNull() & most.isNotNull(), F.concat(least.cast("string"), F.lit("–"), most.cast("string")))
        .when(least.isNotNull(), F.concat(least.cast("string"), F.lit("+")))
        .otherwise("Unknown")
    )


def confidence_label(x: Column) -> Column:
    return F.when(x >= 0.75, "high").when(x >= 0.4, "medium").otherwise("low")
