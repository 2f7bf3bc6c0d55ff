"""Structured search over companies (FLT-29..50, PRJ-01..05, SRT-02/03)."""

from __future__ import annotations

from dataclasses import dataclass, fields as fields_of
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import filter_tree as tree

# How unknown values are handled, and the default page.
DEFINITE_ONLY, DEFINITE_AND_POSSIBLE, UNKNOWN_SEPARATELY = "definite_only", "definite_and_possible", "include_unknown_separately"
PAGE, LARGEST_PAGE = 20, 200
DEFAULT_SORT = [("confidence", "desc")]


def in_scope(companies: DataFrame, key: str, countries: list[str] | None = None, observations: DataFrame | None = None, sources: list | None = None) -> DataFrame:
    """FLT-29, FLT-30: crisp scopes, before anything else is computed. The observations' sources are a semi-join."""
    if countries:
        companies = companies.filter(F.col("country_code").isin(*countries))
    if sources and observations is not None:
        seen = observations.filter(F.col("source_id").isin(*sources)).select(key)
        companies = companies.join(seen, key, "left_semi")
    return companies


def advanced(
    companies: DataFrame, node: tree.Node, key: str = "company_id", sort: list[tuple[str, str]] | None = None, handling: str = DEFINITE_AND_POSSIBLE,
    offset: int = 0, limit: int | None = PAGE,
) -> DataFrame:
    """FLT-32: a page of matches with ``match_strength``. Definite-only keeps the predicate (it is pushed down) and adds
    the strength before the page is cut."""
    found = tree.annotate(companies, node)
    if handling == DEFINITE_ONLY:
        found = found.filter("strength = 3")
    found = found.withColumn("match_strength", tree.strength_name(F.col("strength"))).drop("strength")
    if limit is None:
        return found
    return found.orderBy(*tree.compile_sort(sort or DEFAULT_SORT, key)).offset(offset).limit(limit)


def unknown_bucket(
    companies: DataFrame, node: tree.Node, key: str = "company_id", sort: list[tuple[str, str]] | None = None, offset: int = 0, limit: int | None = PAGE,
    countries: list[str] | None = None, observations: DataFrame | None = None, sources: list | None = None,
) -> DataFrame:
    """FLT-31, within scopes: rows that fail only for what is unknown: each condition holds or its field is null, and one is null.
    For single conditions and flat ANDs; other trees have none."""
    parts = [node] if isinstance(node, tree.Condition) else node.conditions if node.op == "AND" else []
    if not parts or any(isinstance(x, tree.Group) for x in parts):
        return companies.filter(F.lit(False))
    companies = in_scope(companies, key, countries, observations, sources)
    some, every = F.lit(False), F.lit(True)
    for part in parts:
        unknown = tree.is_unknown(tree.spec_of(part, tree.FIELDS))
        some, every = some | unknown, every & (unknown | tree.compile_tree(part)[0])
    found = companies.filter(every & some)
    return found if limit is None else found.orderBy(*tree.compile_sort(sort or DEFAULT_SORT, key)).offset(offset).limit(limit)


@dataclass(frozen=True)
class FlatFilters:
    """The shorthand query's parameters; all that are given hold together."""

    industry: str | None = None
    product: str | None = None
    city: str | None = None
    state: str | None = None
    country: str | None = None
    employee_min: int | None = None
    employee_max: int | None = None
    revenue_min_inr: float | None = None
    revenue_max_inr: float | None = None
    incorporated_before: date | None = None
    incorporated_after: date | None = None
    company_category: str | None = None
    export_status: bool | None = None
    min_confidence: float | None = None
    last_verified_after: datetime | None = None
    verification_type: str | None = None
    offset: int = 0
    limit: int = PAGE

    def __post_init__(self):
        """FLT-50."""
        for f in fields_of(self):
            value = getattr(self, f.name)
            if f.name.startswith(("employee", "revenue", "offset")) and value is not None and value < 0:
                raise tree.InvalidFilterConditionError(f"{f.name} is below 0")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 1:
            raise tree.InvalidFilterConditionError("min_confidence is beyond 0 to 1")
        if not 1 <= self.limit <= LARGEST_PAGE:
            raise tree.InvalidFilterConditionError("limit is beyond 1 to 200")


def _like(column: Column, value: str) -> Column:
    """FLT-40: wildcards in the value stay wildcards."""
    return F.lower(column).like(f"%{value.lower()}%")


def _span(exact: str, low: str, high: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(exact), F.col(low)), F.coalesce(F.col(exact), F.col(high))


def definiteness(f: FlatFilters) -> Column:
    """FLT-49: null without a range filter; a bound that isn't known never makes it false."""
    definite, active = F.lit(True), False
    for name, bounds in (("employee", ("employee_count", "employee_range_min", "employee_range_max")),
                         ("revenue", ("annual_revenue_inr", "revenue_range_min_inr", "revenue_range_max_inr"))):
        lo, hi = _span(*bounds)
        suffix = "_inr" if name == "revenue" else ""
        least, most = getattr(f, f"{name}_min{suffix}"), getattr(f, f"{name}_max{suffix}")
        active = active or least is not None or most is not None
        if least is not None:
            definite &= F.coalesce(lo >= least, F.lit(True))
        if most is not None:
            definite &= F.coalesce(hi <= most, F.lit(True))
    return definite if active else F.lit(None).cast("boolean")


def flat(companies: DataFrame, f: FlatFilters, evidence: DataFrame | None = None, key: str = "company_id", page: bool = True) -> DataFrame:
    """FLT-40..49: the shorthand query, with ``match_is_definite``."""
    tests: list[Column] = [_like(F.col(n), v) for n in ("industry", "city", "state", "country") if (v := getattr(f, n))]
    if f.product:
        tests.append(F.exists("products", lambda p: _like(p, f.product)))
    for least, most, bounds in (
        (f.employee_min, f.employee_max, ("employee_count", "employee_range_min", "employee_range_max")),
        (f.revenue_min_inr, f.revenue_max_inr, ("annual_revenue_inr", "revenue_range_min_inr", "revenue_range_max_inr")),
    ):
        lo, hi = _span(*bounds)
        tests += [hi >= least] if least is not None else []
        tests += [lo <= most] if most is not None else []
    if f.incorporated_before:
        tests.append(F.col("incorporation_date") < F.lit(f.incorporated_before))
    if f.incorporated_after:
        tests.append(F.col("incorporation_date") >= F.lit(f.incorporated_after))
    if f.company_category:
        tests.append(F.col("company_category") == f.company_category)
    if f.export_status is not None:
        tests.append(F.col("export_status") == f.export_status)
    if f.min_confidence is not None:
        tests.append(F.col("confidence") >= f.min_confidence)
    if f.last_verified_after is not None:
        tests.append(F.col("last_verified_at") >= F.lit(f.last_verified_after))
    for test in tests:
        companies = companies.filter(test)
    if f.verification_type:
        proven = evidence.filter(F.col("verification_type") == f.verification_type).select(key)
        companies = companies.join(proven, key, "left_semi")
    out = companies.withColumn("match_is_definite", definiteness(f))
    return out.orderBy(F.col("confidence").desc_nulls_last(), F.col(key)).offset(f.offset).limit(f.limit) if page else out


def with_sources(found: DataFrame, names: DataFrame, key: str = "company_id") -> DataFrame:
    """PRJ-02, PRJ-03: each row's source names, none as an empty list."""
    empty = F.array().cast("array<string>")
    return found.join(names, key, "left").withColumn("sources", F.coalesce("sources", empty))


def selected(found: DataFrame, names: list[str]) -> DataFrame:
    """PRJ-05."""
    if missing := [n for n in names if n not in found.columns]:
        raise tree.UnknownFilterFieldError(", ".join(missing))
    return found.select(*names)


#: What a saved search may hold.
SAVED_KEYS = frozenset({"name", "filter_json", "country_scope", "source_scope", "sort", "handling", "offset", "limit", "selected_fields"})


def run_saved(companies: DataFrame, saved: dict, observations: DataFrame | None = None, key: str = "company_id") -> DataFrame:
    """A saved search: its filter as JSON, scopes, sort, handling and fields. A scope of sources needs the observations.

    Where unknown rows are asked for separately, ``bucket`` tells them from the results; each of the two has a page of its own. Without
    ``selected_fields`` all columns are returned, with them these alone, behind the bucket."""
    if unknown := sorted(set(saved) - SAVED_KEYS):
        raise tree.InvalidFilterConditionError(f"unknown keys: {', '.join(unknown)}")
    if saved.get("source_scope") and observations is None:
        raise tree.InvalidFilterConditionError("a scope of sources needs observations")
    handling = saved.get("handling", DEFINITE_AND_POSSIBLE)
    if handling not in (DEFINITE_ONLY, DEFINITE_AND_POSSIBLE, UNKNOWN_SEPARATELY):
        raise tree.InvalidFilterConditionError(f"unknown handling: {handling}")
    node, sort = tree.loads(saved["filter_json"]), [tuple(x) for x in saved.get("sort", [])] or None
    offset, limit = saved.get("offset", 0), saved.get("limit", PAGE)
    scopes = {"countries": saved.get("country_scope"), "observations": observations, "sources": saved.get("source_scope")}
    out = advanced(in_scope(companies, key, **scopes), node, key, sort, handling, offset, limit)
    apart = handling == UNKNOWN_SEPARATELY
    if apart:
        rest = unknown_bucket(companies, node, key, sort, offset, limit, **scopes).withColumns({"match_strength": F.lit("unknown"), "bucket": F.lit("unknown")})
        out = out.withColumn("bucket", F.lit("results")).unionByName(rest)
    fields = saved.get("selected_fields")
    return selected(out, [*fields, *(["bucket"] if apart and "bucket" not in fields else [])]) if fields else out


def with_unknown(
    companies: DataFrame, node: tree.Node, names: DataFrame, key: str = "company_id", limit: int | None = PAGE
) -> DataFrame:
    """PRJ-03: matches with their strength, and the unknown ones, each row in its ``bucket``, with source names."""
    found = advanced(companies, node, key, limit=limit).withColumn("bucket", F.lit("results"))
    unknown = unknown_bucket(companies, node, key, limit=limit).withColumns({"match_strength": F.lit("unknown"), "bucket": F.lit("unknown")})
    return with_sources(found.unionByName(unknown), names, key)
