"""The driver's tables as companies, observations, sources, jobs and pages: one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")

COMPANIES = """
SELECT c.c_custkey AS company_id, c.c_name AS canonical_name, n.n_name AS state,
  CASE WHEN c.c_custkey % 11 <> 0 THEN n.n_name END AS city, r.r_name AS country, substr(r.r_name, 1, 2) AS country_code,
  c.c_mktsegment AS industry,
  CASE WHEN c.c_custkey % 5 IN (0, 2) THEN o.cnt END AS employee_count,
  CASE WHEN c.c_custkey % 5 = 3 THEN o.cnt - 3 END AS employee_range_min,
  CASE WHEN c.c_custkey % 5 = 3 AND c.c_custkey % 35 <> 3 THEN o.cnt + 3 END AS employee_range_max,
  CASE WHEN c.c_custkey % 5 IN (0, 1) THEN o.rev END AS annual_revenue_inr,
  CASE WHEN c.c_custkey % 5 = 3 THEN o.rev * CAST(0.7 AS DOUBLE) END AS revenue_range_min_inr,
  CASE WHEN c.c_custkey % 5 = 3 THEN o.rev * CAST(1.3 AS DOUBLE) END AS revenue_range_max_inr,
  CAST(o.first_order AS DATE) AS incorporation_date,
  CASE c.c_custkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS export_status,
  CASE WHEN c.c_custkey % 6 <> 0 THEN CAST(c.c_custkey % 1000 AS DOUBLE) / 1000 END AS confidence,
  CASE c.c_custkey % 4 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'trader' WHEN 2 THEN 'service_provider' END AS company_category,
  CASE WHEN c.c_custkey % 7 <> 0 THEN CAST(o.last_order AS TIMESTAMP) END AS last_verified_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS cnt, round(sum(o_totalprice), 2) AS rev, min(o_orderdate) AS first_order,
  max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""

SOURCES = """
SELECT s_suppkey AS source_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN concat('Source of ', s_name) END AS display_name,
  s_suppkey % 101 AS reliability_weight, s_acctbal > 0 AS enabled,
  CASE s_suppkey % 4 WHEN 0 THEN 'government_dataset' WHEN 1 THEN 'registry_api' WHEN 2 THEN 'company_website' ELSE 'uploaded' END AS source_type
FROM {supplier}
"""

OBSERVATIONS = """
SELECT o.o_custkey AS company_id, l.l_suppkey AS source_id, concat('f', CAST(l.l_linenumber AS VARCHAR(9))) AS field, l.l_returnflag AS value,
  CASE l.l_partkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'observed' WHEN 2 THEN 'estimated' ELSE 'rumour' END AS verification_type,
  CAST(l.l_shipdate AS TIMESTAMP) AS collected_at,
  concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20)), '-', CAST(l.l_partkey AS VARCHAR(20)), '-', CAST(l.l_suppkey AS VARCHAR(20)), '-',
    CAST(CAST(round(l.l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR(20)), '-', CAST(CAST(round(l.l_quantity * 100, 0) AS BIGINT) AS VARCHAR(20))) AS obs_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

JOBS = """
SELECT event_id AS job_id, user_id AS source_id, concat('k', CAST(event_id % 97 AS VARCHAR(9))) AS idempotency_key,
  CASE event_type WHEN 'signup' THEN 'success' WHEN 'click' THEN 'success' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'partial' END AS status,
  CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) AS started_at, CAST(ts AS TIMESTAMP) AS finished_at,
  CASE WHEN event_type = 'error' THEN concat('error ', CAST(event_id AS VARCHAR(20))) END AS error_summary,
  CAST(floor(value) AS BIGINT) AS records_updated, value, event_type, props
FROM {events}
"""

VIEWS = {"companies": COMPANIES, "sources": SOURCES, "observations": OBSERVATIONS, "jobs": JOBS}


class Tables:
    """Reads tables once asked for; views are their SQL over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])


def duckdb(body: str, *views: str) -> str:
    """A query of the other engine over views."""
    names = {t: t for t in TABLES}
    found = ", ".join(f"{v} AS ({VIEWS[v].format(**names)})" for v in views)
    rest = body.lstrip()
    if not found:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.upper().startswith(start):
            return f"{start}{found}, {rest[len(start):]}"
    return f"WITH {found} {body}"
