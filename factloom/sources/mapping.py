"""Foreign columns to canonical fields (MAP-01..04, SET-02, AGG-14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text

# Canonical fields, and the names that sources give them.
REGISTRY_FIELDS = (
    "cin", "company_name", "company_status", "company_class", "company_category", "date_of_registration", "registered_state",
    "registered_office_address", "roc", "authorized_capital", "paidup_capital",
)
REGISTRY_NAMES = {
    "CIN": "cin", "COMPANY_NAME": "company_name", "COMPANY_STATUS": "company_status", "COMPANY_CLASS": "company_class",
    "COMPANY_CATEGORY": "company_category", "COMPANY_SUB_CATEGORY": "company_category", "DATE_OF_REGISTRATION": "date_of_registration",
    "DATE_OF_INCORPORATION": "date_of_registration", "REGISTERED_STATE": "registered_state",
    "REGISTERED_OFFICE_ADDRESS": "registered_office_address", "ROC": "roc", "REGISTRAR_OF_COMPANIES": "roc", "ROC_CODE": "roc",
    "AUTHORIZED_CAPITAL": "authorized_capital", "AUTHORIZED_CAP": "authorized_capital", "PAIDUP_CAPITAL": "paidup_capital",
    "PAID_UP_CAPITAL": "paidup_capital",
}
CUSTOM_TYPES = {
    "legal_name": "string", "cin": "string", "gstin": "string", "website": "string", "public_phone": "string", "public_email": "string",
    "registered_address": "string", "city": "string", "state": "string", "postal_code": "string", "country": "string",
    "country_code": "string", "industry": "string", "sub_industry": "string", "company_type": "string", "company_category": "string",
    "products": "string", "services": "string", "incorporation_date": "date", "employee_count": "number",
    "employee_range_min": "number", "employee_range_max": "number", "annual_revenue_inr": "number", "revenue_range_min_inr": "number",
    "revenue_range_max_inr": "number", "revenue_year": "number", "export_status": "boolean",
}


class MappingError(ValueError):
    """A mapping that names no known field, one twice, or no company name."""


@dataclass(frozen=True)
class Comparison:
    unknown: list[str]
    matched: list[str]
    missing: list[str]
    missing_required: list[str]


def renamed(rows: DataFrame, names: dict[str, str] = REGISTRY_NAMES, fields: tuple[str, ...] = REGISTRY_FIELDS) -> DataFrame:
    """MAP-01/02: canonical columns, unknown ones dropped; of two foreign columns for one field, the later that has a value
    holds. Decided at plan time, so one projection."""
    by_field: dict[str, list[str]] = {}
    for column in rows.columns:
        if field := names.get(text.clean_external_key(column)):
            by_field.setdefault(field, []).insert(0, column)
    return rows.select(
        *(F.coalesce(*(F.col(f"`{c}`") for c in by_field[f])).alias(f) if f in by_field else F.lit(None).cast("string").alias(f) for f in fields)
    )


def compare(observed: list[str], names: dict[str, str] = REGISTRY_NAMES, fields: tuple[str, ...] = REGISTRY_FIELDS, required: tuple[str, ...] = ("cin",)) -> Comparison:
    """AGG-14, SET-02: a file's columns against what is expected."""
    known = {c: names.get(text.clean_external_key(c)) for c in observed}
    matched = {f for f in known.values() if f}
    missing = [f for f in fields if f not in matched]
    return Comparison(sorted(c for c, f in known.items() if not f), [f for f in fields if f in matched], missing, [f for f in missing if f in required])


def compared(names: DataFrame, expected: list[str]) -> DataFrame:
    """compare() over a table of (dataset, columns array) rows."""
    wanted = F.array(*(F.lit(x) for x in expected))
    keys = F.transform("columns", text.external_key)
    return names.select(
        "dataset",
        F.sort_array(F.array_except(keys, wanted)).alias("unknown"),
        F.sort_array(F.array_intersect(keys, wanted)).alias("matched"),
        F.sort_array(F.array_except(wanted, keys)).alias("missing"),
    )


def validate(mapping: dict[str, str], columns: list[str] | None = None) -> None:
    """MAP-04: mapping from a file's columns to fields."""
    if not mapping:
        raise MappingError("the mapping is empty")
    if unknown := sorted(set(mapping.values()) - set(CUSTOM_TYPES)):
        raise MappingError(f"unknown fields: {', '.join(unknown)}")
    if len(set(mapping.values())) < len(mapping):
        raise MappingError("a field is mapped twice")
    if "legal_name" not in mapping.values():
        raise MappingError("no column is mapped to legal_name")
    if columns is not None and (absent := sorted(set(mapping) - set(columns))):
        raise MappingError(f"no such columns: {', '.join(absent)}")


def mapped(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """MAP-03: the mapped columns as trimmed text; missing cells are empty."""
    validate(mapping, rows.columns)
    return rows.select(*(F.coalesce(text.strip_all(F.col(f"`{c}`").cast("string")), F.lit("")).alias(f) for c, f in mapping.items()))
