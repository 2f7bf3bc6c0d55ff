"""Text normalisers as Columns (STR-*)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end a company's name.
LEGAL_SUFFIXES = (
    "private limited", "pvt ltd", "pvt. ltd.", "pvt limited", "public limited", "limited liability partnership", "llp", "limited",
    "ltd", "incorporated", "inc", "corporation", "corp", "company", "co",
)
_LONGEST_FIRST = "|".join(x.replace(".", r"\.") for x in sorted(LEGAL_SUFFIXES, key=len, reverse=True))
SUFFIX = rf"(?iU)[\s,.]*\b({_LONGEST_FIRST})\.?\s*$"
# Registry number, secrets in text, schemes of public addresses.
CIN = "^[A-Za-z][0-9]{5}[A-Za-z]{2}[0-9]{4}[A-Za-z]{3}[0-9]{6}$"
SECRET = r"""(?i)((?:x-)?(?:api[-_]?key|token|secret))['"]?\s*[:=]\s*['"]?[^&\s'"]+"""
SAFE_SCHEMES = ("http", "https")
#: Public addresses of version 6, and what of them isn't.
GLOBAL_V6, PRIVATE_V6 = r"^[23][0-9a-f]{3}:", r"^(?:2001:(?:0{0,3}:|0?[01]?[0-9a-f]{1,2}:|:|0?db8:)|2002:|3fff:)"
#: Letters whose row of bits can be doubled without leaving 64 bits.
ROW_BITS = 62
PRIVATE_HOST = (
    r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|"
    r"22[4-9]\.|2[3-5][0-9]\.|localhost$)"
)


def strip_all(x: Column) -> Column:
    """Without white space of any kind at its ends; trim() takes blanks only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_legal_suffix(name: Column) -> Column:
    """STR-01: one trailing legal form less; a name that is nothing else stays."""
    rest = strip_all(F.regexp_replace(name, SUFFIX, ""))
    return F.when(rest == "", strip_all(name)).otherwise(rest)


def normalize_company_name(name: Column) -> Column:
    """STR-02: lower case, word characters only, no legal form; null is the empty string."""
    words = F.regexp_replace(F.lower(strip_legal_suffix(F.coalesce(name, F.lit("")))), r"(?U)[^\w\s]", " ")
    return normalize_whitespace(words)


def normalize_whitespace(x: Column) -> Column:
    """STR-03."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def extract_postal_code(x: Column) -> Column:
    """STR-04: the first six digits that stand alone."""
    return F.nullif(F.regexp_extract(x, r"\b(\d{6})\b", 1), F.lit(""))


def normalize_domain(x: Column) -> Column:
    """STR-05: the host, without a leading www."""
    value = strip_all(x)
    value = F.when(F.contains(value, F.lit("://")), value).otherwise(F.concat(F.lit("http://"), value))
    host = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def email_domain(x: Column) -> Column:
    """STR-06."""
    return F.when(F.contains(x, F.lit("@")), F.lower(F.substring_index(x, "@", -1)))


def title_case(x: Column) -> Column:
    """STR-07: a capital after every character that is no letter, small letters elsewhere; initcap only knows blanks."""
    parts = F.regexp_extract_all(x, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def identifier(x: Column) -> Column:
    """STR-08."""
    return F.upper(strip_all(x))


def comma_list(x: Column) -> Column:
    """STR-09: the list's parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), strip_all), lambda p: p != "")


def external_key(x: Column) -> Column:
    """STR-11: a foreign column's name up to a bracket, in capitals."""
    return F.upper(strip_all(F.substring_index(x, "(", 1)))


def clean_external_key(name: str) -> str:
    """external_key() at plan time."""
    return name.split("(")[0].strip().upper()


def scrub_secrets(x: Column) -> Column:
    """STR-12."""
    return F.regexp_replace(x, SECRET, "$1=***")


def safe_url(x: Column) -> Column:
    """STR-15: a public http(s) address without credentials; names are not resolved."""
    scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    # a host that is one number is an address of version 4
    number = F.when(host.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(host, 3, 8), 16, 10)).when(host.rlike("^[0-9]{1,10}$"), host).try_cast("bigint")
    dotted = F.concat_ws(".", *(F.shiftright(number, n).bitwiseAND(F.lit(255)).cast("string") for n in (24, 16, 8, 0)))
    host = F.when(number.between(0, 2**32 - 1), dotted).otherwise(host)
    inside = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    public = F.when(host.startswith("["), inside.rlike(GLOBAL_V6) & ~inside.rlike(PRIVATE_V6)).otherwise(~host.rlike(PRIVATE_HOST))
    plain = ~F.contains(authority, F.lit("@")) & (host != "") & public
    return F.coalesce(scheme.isin(*SAFE_SCHEMES) & plain, F.lit(False))


def valid_cin(x: Column) -> Column:
    """STR-16: the pattern; ``length`` 21 alone is what the registry scan asks for."""
    return F.coalesce(strip_all(x).rlike(CIN), F.lit(False))


def trigrams(x: Column) -> Column:
    """STR-14: distinct three-letter pieces of the words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(x), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: _pieces(F.concat(F.lit("  "), w, F.lit(" "))))
    return F.array_distinct(F.flatten(pieces))


def _pieces(padded: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """STR-14: shared pieces of all pieces."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != "")), " ")


def _common_by_rows(first: Column, second: Column) -> Column:
    """Length of the longest common subsequence of two arrays, row by row of the usual table."""
    zero = F.transform(F.concat(F.array(F.lit("")), second), lambda _: F.lit(0))

    def line(above: Column, x: Column) -> Column:
        def cell(row: Column, i: Column) -> Column:
            diagonal = F.element_at(above, i) + 1
            best = F.greatest(F.element_at(row, -1), F.element_at(above, i + 1))
            return F.concat(row, F.array(F.when(F.element_at(second, i) == x, diagonal).otherwise(best)))

        places = F.when(F.size(second) > 0, F.sequence(F.lit(1), F.size(second))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(first, zero, line), -1)


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas ask for it again and again."""
    return F.get(F.transform(F.array(value), use), 0)


def _longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence. As neighbours in a row of the usual table differ by one or nothing, a row is the bits of a
    number where the shorter text has at most ``ROW_BITS`` letters."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    zero = F.lit(0).cast("long")

    def by_bits(s: Column) -> Column:
        of_letter = F.transform(s.first, lambda x: F.aggregate(s.places, zero, lambda held, p: F.when(p.c == x, held.bitwiseOR(p.bit)).otherwise(held)))
        row = F.aggregate(of_letter, s.whole, lambda v, k: (v + v.bitwiseAND(k)).bitwiseOR(v - v.bitwiseAND(k)).bitwiseAND(s.whole))
        return F.size(s.places) - F.bit_count(row)

    def judged(s: Column) -> Column:
        places = F.transform(s.second, lambda c, i: F.struct(c.alias("c"), bit(i).alias("bit")))
        bits = _held(F.struct(s.first.alias("first"), places.alias("places"), (bit(F.size(s.second)) - 1).alias("whole")), by_bits)
        return F.when(F.size(s.second) <= ROW_BITS, bits).otherwise(_common_by_rows(s.first, s.second))

    shorter = F.length(a) <= F.length(b)
    return _held(F.struct(letters(F.when(shorter, b).otherwise(a)).alias("first"), letters(F.when(shorter, a).otherwise(b)).alias("second")), judged)


def token_sort_similarity(a: Column, b: Column) -> Column:
    """STR-13: 2 * LCS / (both lengths) of the names' sorted tokens; 0 if either is empty."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    ratio = 2.0 * _longest_common(x, y) / (F.length(x) + F.length(y))
    return F.when((x == "") | (y == ""), 0.0).otherwise(ratio)


def python_trigrams(text: str) -> set[str]:
    """trigrams() for tests and plan-time values."""
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}
