"""Rows as they are shown (PRJ-01, PRJ-07) and the fixed orders of lists (SRT-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a company shows, in order.
COMPANY = (
    "id", "canonical_name", "legal_name", "website_domain", "cin", "gstin", "incorporation_date", "company_type", "registered_address", "city",
    "state", "country", "country_code", "postal_code", "industry", "sub_industry", "products", "services", "company_category", "export_status",
    "employee_count", "employee_range_min", "employee_range_max", "annual_revenue_inr", "revenue_range_min_inr", "revenue_range_max_inr",
    "revenue_year", "public_phone", "public_email", "website", "confidence", "last_verified_at",
)


def company_out(companies: DataFrame, key: str = "company_id") -> DataFrame:
    """PRJ-01: all of a company's columns, decimals as doubles; what a table hasn't got is null."""
    lists = {"products", "services", "operating_locations", "markets_served"}

    def shown(name: str):
        source = key if name == "id" else name
        if source not in companies.columns:
            return F.lit(None).cast("array<string>" if name in lists else "string").alias(name)
        c = F.col(source)
        return (c.cast("double") if isinstance(companies.schema[source].dataType, T.DecimalType) else c).alias(name)

    return companies.select(*(shown(n) for n in COMPANY))


def by_name(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.asc_nulls_last("name"), "source_id")


def newest_first(rows: DataFrame, time: str, key: str) -> DataFrame:
    """Jobs, saved searches."""
    return rows.orderBy(F.desc_nulls_last(time), key)


def oldest_first(rows: DataFrame, time: str, key: str) -> DataFrame:
    """The review queue."""
    return rows.orderBy(F.asc_nulls_last(time), key)


def financial_history(financials: DataFrame, company: object) -> DataFrame:
    """A company's years, the latest first; years are text."""
    return financials.filter(F.col("company_id") == company).orderBy(F.desc("financial_year"))


def gst_registrations(registrations: DataFrame, company: object) -> DataFrame:
    """A company's registrations, the primary one first, then by state."""
    return registrations.filter(F.col("company_id") == company).orderBy(F.desc("is_primary"), F.asc_nulls_last("state"), "gstin")
