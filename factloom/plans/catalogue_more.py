"""More registered queries: files, nested and web sources, custom mappings, canonical companies, saved searches, name matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import evidence, filter_tree as tree, health, projections, resolution, search
from factloom.operators.cut import scratch
from factloom.plans import filter_sql, ingest
from factloom.plans.bridge import Tables
from factloom.plans.catalogue import _NAMED, _ROLLED, _TRIGRAMS, AS_OF, C, G, _signals, query
from factloom.sources import adapters, demo, mapping, sinks


def _structs(spark_side: bool, rows: list[dict[str, str]]) -> str:
    """Rows made of each row, as an expression of either engine."""
    if spark_side:
        return "inline(array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in r.items()) + ")" for r in rows) + "))"
    return "unnest([" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in r.items()) + "}" for r in rows) + "])"


# --- files ------------------------------------------------------------------------------------------------------------

_CSV_NAME = "concat('\"', canonical_name, '\", of ', state)"


@query(
    f"SELECT concat('U12345MH2001PTC', lpad(CAST(company_id AS VARCHAR), 6, '0')) AS cin, {_CSV_NAME} AS company_name, 'Active' AS company_status, coalesce(industry, '') AS company_class, "
    "coalesce(company_category, '') AS company_category, coalesce(CAST(incorporation_date AS VARCHAR), '') AS date_of_registration, trim(concat(state, ' ')) AS registered_state, "
    "concat('Line 1', chr(10), 'Line 2') AS registered_office_address, '' AS roc, CAST(company_id AS VARCHAR) AS authorized_capital, '' AS paidup_capital, company_id < 1000000 AS valid "
    "FROM companies WHERE company_id % 13 <> 0",
    "companies",
)
def csv_round_trip(t: Tables) -> DataFrame:
    """SRC-01, SRC-03..05, MAP-01, SNK-07: a registry's file written and read again, all columns."""
    rows = t.view("companies").select(
        F.expr("CASE WHEN company_id % 13 <> 0 THEN concat('U12345MH2001PTC', lpad(CAST(company_id AS STRING), 6, '0')) ELSE '  ' END").alias("﻿CIN"),
        F.expr(_CSV_NAME).alias("COMPANY_NAME"), F.lit("Active").alias("COMPANY_STATUS(for efiling)"), F.col("industry").alias("Company_Class"),
        F.col("company_category").alias("COMPANY_SUB_CATEGORY"), F.col("incorporation_date").cast("string").alias("DATE_OF_INCORPORATION"),
        F.concat("state", F.lit(" ")).alias("REGISTERED_STATE"), F.lit("Line 1\nLine 2").alias("REGISTERED_OFFICE_ADDRESS"),
        F.col("company_id").cast("string").alias("AUTHORIZED_CAP"), F.lit("x").alias("SOME_FUTURE_FIELD"),
    )
    path = scratch(t.spark, "csv")
    rows.write.option("escape", '"').csv(path, header=True)
    found = adapters.registry_records(adapters.read_rows(t.spark, path))
    return found.select(*mapping.REGISTRY_FIELDS, "valid")


@query("SELECT CAST(job_id AS VARCHAR) AS a, 'x' AS b FROM jobs UNION ALL SELECT concat('n', CAST(job_id AS VARCHAR)), NULL FROM jobs WHERE job_id % 2 = 0", "jobs")
def json_envelope(t: Tables) -> DataFrame:
    """SRC-02: bare arrays, and objects with records, with a byte order mark or not."""
    content = F.expr(
        """CASE WHEN job_id % 2 = 0 THEN concat('﻿ [{"a": "', job_id, '", "b": "x"}, {"a": "n', job_id, '"}]') ELSE concat('{"records": [{"a": "', job_id, '", "b": "x"}]}') END"""
    )
    return adapters.unwrapped(t.view("jobs").select(content.alias("content"))).select("a", "b")


@query(
    "SELECT source_id, count(*) AS rows, epoch_us(min(TIMESTAMP '2002-01-01')) AS collected_at, 2 * count(*) AS twice FROM observations GROUP BY 1", "observations"
)
def append_observations(t: Tables) -> DataFrame:
    """SNK-01, SNK-05: two batches appended; a dry run between them leaves nothing."""
    path, rows = scratch(t.spark, "observations"), t.view("observations").drop("collected_at")
    sinks.append_observations(rows, path, AS_OF)
    sinks.write_all({"more": rows}, path, dry_run=True)
    once = t.spark.read.parquet(path).groupBy("source_id").agg(F.count("*").alias("rows"), F.unix_micros(F.min("collected_at")).alias("collected_at"))
    sinks.append_observations(rows, path, AS_OF)
    twice = t.spark.read.parquet(path).groupBy("source_id").agg(F.count("*").alias("twice"))
    return once.join(twice, "source_id").select(F.col("source_id").cast("bigint").alias("source_id"), "rows", "collected_at", "twice")


@query(
    "SELECT o.company_id, 'import.csv' AS source_file, sha256('a,b' || chr(10) || '1,2' || chr(10)) AS digest, '8' AS bytes, CASE WHEN o.company_id % 2 = 0 THEN 'kept' END AS note, count(*) AS n "
    "FROM observations o GROUP BY 1, 5",
    "observations",
)
def file_provenance(t: Tables) -> DataFrame:
    """SNK-10: a file's name, size and digest in the metadata of what came from it."""
    path = scratch(t.spark, "file")
    t.spark.createDataFrame([("a,b\n1,2",)], "value string").coalesce(1).write.text(path)
    found = sinks.provenance(t.spark, path).first().metadata  # of one file
    found["source_file"] = "import.csv"
    entries = F.create_map(*(F.lit(x) for kv in sorted(found.items()) for x in kv))
    old = F.expr("CASE WHEN company_id % 2 = 0 THEN map('note', 'kept', 'bytes', 'old') END")
    rows = sinks.with_provenance(t.view("observations").withColumn("metadata", old), entries)
    m = F.col("metadata")
    return rows.groupBy("company_id", m["source_file"].alias("source_file"), m["sha256"].alias("digest"), m["bytes"].alias("bytes"), m["note"].alias("note")).agg(F.count("*").alias("n"))


@query(
    "SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'bad' ELSE 'ok' END AS part, CASE WHEN job_id % 3 <> 0 THEN job_id END AS value FROM jobs", "jobs"
)
def bad_rows_apart(t: Tables) -> DataFrame:
    """SNK-06."""
    rows = t.view("jobs").select("job_id", F.expr("CASE WHEN job_id % 3 = 0 THEN 'x' ELSE CAST(job_id AS STRING) END").try_cast("bigint").alias("value"))
    ok, bad = sinks.split_bad(rows, F.col("value").isNotNull())
    return ok.withColumn("part", F.lit("ok")).unionByName(bad.withColumn("part", F.lit("bad")))


@query(
    "SELECT company_id, CASE company_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'set' ELSE industry END AS industry, CASE WHEN company_id % 4 = 1 THEN state ELSE coalesce(state, '') END AS state "
    "FROM companies WHERE company_id % 10 <> 3 UNION ALL SELECT -1, 'made', 'here'",
    "companies",
)
def saved_rows_rewritten(t: Tables) -> DataFrame:
    """SNK-09: rows created, changed (also to null) and deleted."""
    base = t.view("companies").select("company_id", "industry", "state")
    patch = base.filter("company_id % 4 < 2").select(
        "company_id", F.expr("CASE WHEN company_id % 4 = 1 THEN 'set' END").alias("industry"), F.lit("unused").alias("state"), F.array(F.lit("industry")).alias("fields")
    )
    kept = sinks.without(base, base.filter("company_id % 10 = 3"), "company_id")
    made = t.spark.createDataFrame([(-1, "made", "here")], "company_id long, industry string, state string")
    return sinks.upserted(sinks.patched(kept, patch, "company_id", ["industry", "state"], "fields"), made, ["company_id"])


# --- nested registry, web pages, custom files ---------------------------------------------------------------------------

_CIN = "concat('U12345MH2001PTC', lpad(CAST(company_id AS VARCHAR(20)), 6, '0'))"
_ID = "CAST(company_id AS VARCHAR(20))"


def _nested(t: Tables) -> DataFrame:
    """Documents in the three shapes that addresses and names come in."""
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    cin, name, state, n = F.expr(_CIN), F.col("canonical_name"), F.col("state"), F.col("company_id").cast("string")
    docs = s('{"data": {"cin": " ', F.lower(cin), '", "company": "', name, '", "masterData": {"companyData": {"companyStatus": "Active", "classOfCompany": "Private", "rocCode": "RoC-', n,
             '", "authorisedCapital": "', n, '", "paidupCapital": "7", "dateOfIncorporation": "05/04/1999", "MCAMDSCompanyAddress": [{"addressType": "Other", "city": "No"}, ',
             '{"addressType": "Registered Address", "addressLine1": "1 A", "addressLine2": "", "city": "Pune ", "state": "', state, '", "pinCode": "411001"}]}}}}')
    live = s('{"data": {"cin": "', cin, '", "company": "', name, '", "masterData": {"commonData": {"status": "Strike Off", "ROCName": "Common"}, "companyData": {"rocName": "RoC-', n,
             '", "paidUpCapital": "N.A.", "pan": "abcde', n, '", "companyCategory": "By shares", "MCAMDSCompanyAddress": [{"streetAddress": "2  B", "streetAddress2": "West", "city": "', state,
             '", "state": "Goa", "postalCode": 403001}]}}}}')
    common = s('{"data": {"cin": "', cin, '", "company": "', name, '", "masterData": {"commonData": {"status": "Dormant", "ROCName": "RoC-', n, '", "companyAddress": [{"addressline1": "3", "addressline2": "C", ',
               '"city": "Nagpur", "state": "', state, '", "pincode": "440001"}]}, "companyData": {"MCAMDSCompanyAddress": []}}}}')
    content = F.when(F.col("company_id") % 4 == 0, docs).when(F.col("company_id") % 4 == 1, live).when(F.col("company_id") % 4 == 2, common).otherwise('{"data": {"company": "no number"}}')
    return t.view("companies").select("company_id", content.alias("content"))


_NESTED_SQL = f"""n AS (SELECT company_id % 4 AS kind, {_CIN} AS cin, canonical_name AS company_name, concat('RoC-', {_ID}) AS roc, state, company_id, {_ID} AS num FROM companies WHERE company_id % 4 < 3),
  registry AS (SELECT *, ['Active', 'Strike Off', 'Dormant'][kind + 1] AS company_status, ['1 A, Pune , ' || state || ', 411001', '2 B, West, ' || state || ', Goa, 403001', '3, C, Nagpur, ' || state || ', 440001'][kind + 1] AS address,
  ['411001', '403001', '440001'][kind + 1] AS postal_code, CASE kind WHEN 0 THEN 'Pune ' WHEN 1 THEN state ELSE 'Nagpur' END AS city, CASE kind WHEN 1 THEN 'Goa' ELSE state END AS region FROM n)"""


@query(
    f"WITH {_NESTED_SQL} SELECT cin, company_name, company_status, CASE kind WHEN 0 THEN 'Private' END AS company_class, CASE kind WHEN 1 THEN 'By shares' END AS company_category, "
    "CASE kind WHEN 0 THEN '05/04/1999' END AS date_of_registration, roc, CASE kind WHEN 0 THEN num END AS authorized_capital, CASE kind WHEN 0 THEN '7' WHEN 1 THEN 'N.A.' END AS paidup_capital, "
    "CASE kind WHEN 1 THEN 'abcde' || num END AS pan, city, region AS registered_state, address AS registered_office_address, postal_code, cin AS external_ref, company_id < 1000000 AS valid FROM registry",
    "companies",
)
def nested_registry(t: Tables) -> DataFrame:
    """SRC-06, SRC-07, MAP-02: every column of every shape."""
    return adapters.nested_records(_nested(t))


@query(
    f"""WITH {_NESTED_SQL}, f AS (SELECT cin, unnest([{{'field': 'cin', 'value': cin}}, {{'field': 'country_code', 'value': 'IN'}}, {{'field': 'legal_name', 'value': company_name}},
    {{'field': 'canonical_name', 'value': trim(regexp_replace(lower(company_name), '[^a-z0-9_]+', ' ', 'g'))}}, {{'field': 'company_status', 'value': lower(company_status)}},
    {{'field': 'company_type', 'value': CASE kind WHEN 0 THEN 'private' WHEN 1 THEN 'by shares' END}}, {{'field': 'incorporation_date', 'value': CASE kind WHEN 0 THEN '1999-04-05' END}},
    {{'field': 'state', 'value': lower(region)}}, {{'field': 'registered_address', 'value': address}}, {{'field': 'postal_code', 'value': postal_code}}, {{'field': 'roc', 'value': roc}},
    {{'field': 'authorized_capital_inr', 'value': CASE kind WHEN 0 THEN num END}}, {{'field': 'paidup_capital_inr', 'value': CASE kind WHEN 0 THEN '7' WHEN 1 THEN '' END}},
    {{'field': 'pan', 'value': CASE kind WHEN 1 THEN upper('abcde' || num) END}}, {{'field': 'city', 'value': lower(trim(city))}}]) AS x FROM registry)
    SELECT cin AS external_ref, x.field AS field, nullif(x.value, '') AS value, 'verified' AS verification_type, CAST(0.85 AS DOUBLE) AS confidence FROM f WHERE x.value IS NOT NULL""",
    "companies",
)
def obs_nested(t: Tables) -> DataFrame:
    """OBS-02, STM-07: the nested registry's facts, by the adapter of its source type; a capital that is no number is a fact without a value."""
    records, facts = adapters.ADAPTERS["registry_api"]
    return facts(records(_nested(t))).select("external_ref", "field", "value", "verification_type", "confidence")


_PAGE_SQL = f"""w AS (SELECT company_id, concat('https://site', {_ID}, '.example/') AS url, canonical_name, industry, CASE company_id % 4 WHEN 0 THEN '50-200 employees' WHEN 1 THEN '34' WHEN 2 THEN '1,000+' END AS size,
  CASE WHEN company_id % 3 = 0 THEN concat('12 Road, Pune 41', lpad(CAST(company_id % 10000 AS VARCHAR(9)), 4, '0'), ', India') END AS address FROM companies WHERE company_id % 9 <> 0)"""


def _site(t: Tables) -> DataFrame:
    """Pages with what a parser has to see: character references, unquoted classes, comments, several matches."""
    n, c = F.col("company_id"), F.col
    size = F.expr("CASE company_id % 4 WHEN 0 THEN '50-200 employees' WHEN 1 THEN '34' WHEN 2 THEN '1,000+' END")
    address = F.expr("CASE WHEN company_id % 3 = 0 THEN concat('12 Road, Pune 41', lpad(CAST(company_id % 10000 AS STRING), 4, '0'), ', India') END")
    html = F.concat(
        F.lit('<!DOCTYPE html><html><body><!-- <h1 class="company-name">no</h1> --><h1 class="big company-name">'), F.when(n % 9 != 0, c("canonical_name")).otherwise(""),
        F.when(n % 9 != 0, F.lit(" &amp; <b>not own</b>Co")).otherwise(""), F.lit("</h1><h2 class=company-name>not h1</h2><p class='company-industry x'>"), F.initcap("industry"),
        F.lit("</p><span class=company-industry> &lt;2&gt; </span><a class='company-website'>www.Site"), n.cast("string"), F.lit(".example/x</a><i class=company-email>A@Mail.Example</i>"),
        F.coalesce(F.concat(F.lit("<address class=company-address>"), address, F.lit("</address>")), F.lit("<div class=company-address>no address element</div>")),
        F.coalesce(F.concat(F.lit("<p class=employee-count>"), size, F.lit("</p>")), F.lit("")),
        F.lit("<ul><li class=company-product>Pumps<li class=company-product> Valves  &amp; more</ul></body></html>"),
    )
    return t.view("companies").select("company_id", F.concat(F.lit("https://site"), n.cast("string"), F.lit(".example/")).alias("url"), html.alias("html"))


@query(
    f"WITH {_PAGE_SQL} SELECT url AS external_ref, canonical_name || ' & Co' AS canonical_name, upper(industry[1]) || lower(industry[2:]) || ' <2>' AS industry, 'www.Site' || CAST(company_id AS VARCHAR) || '.example/x' AS website, "
    "CAST(NULL AS VARCHAR) AS public_phone, 'A@Mail.Example' AS public_email, address, size AS employee_count, 'Pumps|Valves & more' AS products FROM w",
    "companies",
)
def website_company(t: Tables) -> DataFrame:
    """SRC-08."""
    found = adapters.website_records(_site(t))
    return found.withColumn("products", F.array_join("products", "|"))


@query(
    f"""WITH {_PAGE_SQL}, f AS (SELECT url, unnest([{{'field': 'canonical_name', 'value': trim(regexp_replace(lower(canonical_name), '[^a-z0-9_]+', ' ', 'g'))}},
    {{'field': 'industry', 'value': lower(industry) || ' <2>'}}, {{'field': 'website', 'value': 'site' || CAST(company_id AS VARCHAR) || '.example'}}, {{'field': 'public_email', 'value': 'a@mail.example'}},
    {{'field': 'address', 'value': address}}, {{'field': 'postal_code', 'value': regexp_extract(address, '[0-9]{{6}}')}}, {{'field': 'employee_count', 'value': CASE WHEN size = '34' THEN '34' END}},
    {{'field': 'employee_range_min', 'value': CASE company_id % 4 WHEN 0 THEN '50' WHEN 1 THEN '34' WHEN 2 THEN '1000' END}},
    {{'field': 'employee_range_max', 'value': CASE company_id % 4 WHEN 0 THEN '200' WHEN 1 THEN '34' END}}, {{'field': 'products', 'value': 'Pumps, Valves & more'}}]) AS x FROM w)
    SELECT url AS external_ref, x.field AS field, x.value AS value, 'observed' AS verification_type, CAST(0.55 AS DOUBLE) AS confidence FROM f WHERE x.value IS NOT NULL""",
    "companies",
)
def obs_website(t: Tables) -> DataFrame:
    """OBS-03, STM-07."""
    records, facts = adapters.ADAPTERS["company_website"]
    return facts(records(_site(t))).select("external_ref", "field", "value", "verification_type", "confidence")


@query(
    "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<li><a href=')) AS links, "
    "array_to_string(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1), ' ') AS targets, "
    "md5(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS heading FROM pages"
)
def html_select(t: Tables) -> DataFrame:
    """SRC-10: css and paths over whole pages."""
    found = adapters.extracted(
        t.table("pages").select("page_id", "html"), {"lang": "html::attr(lang)", "targets": "nav li > a::attr(href)", "links": "//nav//li/a/@href", "heading": "//h1/text()"}
    )
    return found.select(
        "page_id", F.get("lang", F.lit(0)).alias("lang"), F.size("links").cast("bigint").alias("links"), F.array_join("targets", " ").alias("targets"),
        F.md5(F.array_join("heading", "").cast("binary")).alias("heading"),
    )


@query(
    "SELECT l.place, l.url, p.page_id, p.page_id IS NOT NULL AS found FROM (SELECT job_id AS place, concat('https://none.example/', CAST(job_id AS VARCHAR)) AS url FROM jobs WHERE job_id % 50 = 0 "
    "UNION ALL SELECT page_id, url FROM pages) l LEFT JOIN pages p ON l.url = p.url",
    "jobs",
)
def crawl_list(t: Tables) -> DataFrame:
    """SRC-11."""
    missing = t.view("jobs").filter("job_id % 50 = 0").select(F.col("job_id").alias("place"), F.concat(F.lit("https://none.example/"), F.col("job_id").cast("string")).alias("url"))
    urls = missing.union(t.table("pages").select("page_id", "url"))
    return adapters.crawl_order(urls, t.table("pages")).select("place", "url", "page_id", "found")


_ATTEMPT = "CASE WHEN (job_id + n) % 7 = 0 THEN NULL ELSE CASE (job_id * 3 + n) % 5 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 500 WHEN 3 THEN 502 ELSE 404 END END"


@query(
    f"WITH a AS (SELECT job_id, n, {_ATTEMPT} AS status, CASE WHEN job_id % 11 = 0 THEN 10485761 ELSE 10485760 END AS bytes FROM (SELECT job_id, unnest([1, 2, 3, 4, 5]) AS n FROM jobs)), "
    "d AS (SELECT job_id, least(coalesce(min(n) FILTER (WHERE status < 500), 3), 3) AS attempts FROM a GROUP BY 1) "
    "SELECT a.job_id AS url, attempts, status, CASE WHEN status IS NULL THEN 'failed' WHEN status < 400 AND bytes > 10485760 THEN 'too_large' WHEN status < 400 THEN 'ok' WHEN status = 404 THEN 'not_found' "
    "ELSE 'retry' END AS verdict FROM a JOIN d ON a.job_id = d.job_id AND n = attempts",
    "jobs",
)
def fetch_attempts(t: Tables) -> DataFrame:
    """SRC-12: retries, and the cap on an answer's size."""
    rows = t.view("jobs").select("job_id", F.explode(F.array(*(F.lit(i) for i in range(1, 6)))).alias("n"))
    rows = rows.select(F.col("job_id").alias("url"), F.col("n").alias("attempt"), F.expr(_ATTEMPT).alias("status"), F.when(F.col("job_id") % 11 == 0, 10485761).otherwise(10485760).alias("bytes"))
    return adapters.fetched(rows)


_CUSTOM = {
    "Company Name": "CASE WHEN company_id % 12 = 0 THEN '  ' ELSE concat(' ', canonical_name) END", "CIN Number": "CASE WHEN company_id % 3 = 0 THEN concat('c', CAST(company_id AS VARCHAR(20))) END",
    "Site": "CASE WHEN company_id % 3 = 1 THEN concat('Www.S', CAST(company_id AS VARCHAR(20)), '.example') END", "State ": "concat(state, '  x')",
    "Turnover": "CASE company_id % 4 WHEN 0 THEN '12,000.5' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE '7' END", "Founded": "CASE company_id % 3 WHEN 0 THEN '05-04-1999' WHEN 1 THEN 'long ago' ELSE '1999-04-05' END",
    "Exports": "CASE company_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'perhaps' ELSE '' END", "Country": "'in '", "Ignored": "'z'",
}
_CUSTOM_MAP = {"Company Name": "legal_name", "CIN Number": "cin", "Site": "website", "State ": "state", "Turnover": "annual_revenue_inr", "Founded": "incorporation_date", "Exports": "export_status", "Country": "country_code"}
_CUSTOM_SQL = "u AS (SELECT company_id, " + ", ".join(f"coalesce(trim({e}), '') AS {_CUSTOM_MAP[c]}" for c, e in _CUSTOM.items() if c in _CUSTOM_MAP) + " FROM companies)"
_CUSTOM_REF = "coalesce(nullif(cin, ''), nullif(website, ''), concat('row-', CAST(company_id AS VARCHAR))) AS external_ref"


def _custom(t: Tables) -> DataFrame:
    rows = t.view("companies").select("company_id", *(F.expr(e).alias(c) for c, e in _CUSTOM.items()))
    return adapters.custom_records(rows, _CUSTOM_MAP, "company_id")


@query(f"WITH {_CUSTOM_SQL} SELECT {', '.join(_CUSTOM_MAP.values())}, {_CUSTOM_REF}, legal_name <> '' AS valid FROM u", "companies")
def custom_mapping(t: Tables) -> DataFrame:
    """SRC-09, MAP-03, OBS-05."""
    return _custom(t)


@query(
    f"""WITH {_CUSTOM_SQL}, f AS (SELECT {_CUSTOM_REF}, unnest([{{'field': 'legal_name', 'value': legal_name}}, {{'field': 'canonical_name', 'value': trim(regexp_replace(lower(legal_name), '[^a-z0-9_]+', ' ', 'g'))}},
    {{'field': 'cin', 'value': cin}}, {{'field': 'website', 'value': website}}, {{'field': 'state', 'value': state}}, {{'field': 'annual_revenue_inr', 'value': CASE WHEN annual_revenue_inr <> 'n/a' THEN replace(annual_revenue_inr, ',', '') ELSE '' END}},
    {{'field': 'incorporation_date', 'value': CASE WHEN incorporation_date <> 'long ago' THEN '1999-04-05' ELSE '' END}},
    {{'field': 'export_status', 'value': CASE lower(export_status) WHEN 'yes' THEN 'True' WHEN 'no' THEN 'False' ELSE '' END}}, {{'field': 'country_code', 'value': 'IN'}}]) AS x FROM u WHERE legal_name <> '')
    SELECT external_ref, x.field AS field, x.value AS value, 'observed' AS verification_type, CAST(0.4 AS DOUBLE) AS confidence FROM f WHERE x.value <> ''""",
    "companies",
)
def obs_custom(t: Tables) -> DataFrame:
    """OBS-04, MAP-05, STM-07: numbers, dates and truth values; cells that are none are left out, their rows aren't."""
    return adapters.ADAPTERS["uploaded"][1](_custom(t)).select("external_ref", "field", "value", "verification_type", "confidence")


@query(demo.SQL)
def demo_companies(t: Tables) -> DataFrame:
    """SRC-17: all columns."""
    return demo.companies(t.spark)


@query(demo.CUSTOMERS_SQL)
def demo_of_customers(t: Tables) -> DataFrame:
    """SRC-17, SNK-07: a company for each customer, by way of a file in all columns."""
    path = scratch(t.spark, "demo")
    sinks.write_csv(demo.companies_for(t.table("customer").select(F.col("c_custkey").alias("id"))), path)
    rows = t.spark.read.csv(path, header=True)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


_OBJECT = """concat('{"k": ', job_id, ', "v": ', CASE job_id % 5 WHEN 0 THEN '1.5' WHEN 1 THEN '"12"' WHEN 2 THEN 'null' WHEN 3 THEN 'true' ELSE '[1]' END, CASE WHEN job_id % 2 = 0 THEN ', "o": {"a": 1}' ELSE '' END, '}')"""


@query(
    """SELECT 'k' AS field, 'int' AS kinds, count(*) AS seen, min(CAST(job_id AS VARCHAR)) FILTER (WHERE job_id <> 0) AS sample FROM jobs UNION ALL
    SELECT 'v', string_agg(DISTINCT kind, ',' ORDER BY kind), count(*), min(shown) FROM (SELECT ['float', 'str', 'null', 'bool', 'list'][CAST(job_id % 5 AS INTEGER) + 1] AS kind,
    ['1.5', '12', NULL, 'true', '[1]'][CAST(job_id % 5 AS INTEGER) + 1] AS shown FROM jobs) UNION ALL SELECT 'o', 'dict', count(*), min('{"a":1}') FROM jobs WHERE job_id % 2 = 0""",
    "jobs",
)
def schema_kinds(t: Tables) -> DataFrame:
    """SRC-18: every kind of value, "12" apart from 12."""
    rows = t.view("jobs").select(F.expr(_OBJECT.replace("', job_id, '", "', CAST(job_id AS STRING), '")).alias("props"))
    return adapters.discovered_schema(rows, "props").select("field", F.array_join("kinds", ",").alias("kinds"), "seen", "sample")


# --- canonical companies -------------------------------------------------------------------------------------------------

_FACTS = {
    "legal_name": "concat(canonical_name, ' Ltd')", "canonical_name": "lower(canonical_name)", "website": f"concat('w', {_ID}, '.example')",
    "state": "CASE company_id % 4 WHEN 0 THEN 'tamil-nadu' WHEN 1 THEN ' o2brien county ' ELSE upper(state) END", "city": "lower(city)", "country": "concat(' ', country)", "country_code": "lower(country_code)",
    "products": "CASE company_id % 3 WHEN 0 THEN 'Pumps, valves ,,Bolts ' WHEN 1 THEN '' END", "services": "'Repair'", "cin": _CIN, "industry": "industry", "company_category": "company_category",
    "employee_count": f"CASE WHEN company_id % 5 = 4 THEN 'many' ELSE concat({_ID}, '.7') END", "employee_range_min": f"CASE WHEN company_id % 2 = 0 THEN {_ID} END", "revenue_year": "'2023'",
    "annual_revenue_inr": f"concat({_ID}, '000.25')", "export_status": "CASE company_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' END",
    "incorporation_date": "CASE WHEN company_id % 6 = 5 THEN '31/12/1999' ELSE CAST(incorporation_date AS VARCHAR(10)) END",
}
_FACT_ROWS = [
    {"field": f"'{f}'", "n": str(n), "value": e if n < 2 else f"CASE WHEN company_id % 7 = 0 THEN {e} ELSE 'other' END"} for f, e in _FACTS.items() for n in range(3) if n < 2 or f in ("state", "services", "cin")
]
_FACT_COLUMNS = """company_id, (company_id * 3 + n) % 10 + 1 AS source_id, field, value, CASE n WHEN 0 THEN 'observed' WHEN 1 THEN 'verified' ELSE 'estimated' END AS verification_type,
  CASE n WHEN 0 THEN TIMESTAMP '2001-06-01 00:00:00' WHEN 1 THEN TIMESTAMP '2001-09-01 00:00:00' ELSE TIMESTAMP '1999-01-01 00:00:00' END AS collected_at, concat(CAST(company_id AS VARCHAR(20)), '-', field, '-', CAST(n AS VARCHAR(9))) AS obs_id"""
_FACTS_SQL = f"observations AS (SELECT {_FACT_COLUMNS} FROM (SELECT company_id, x.field AS field, x.n AS n, x.value AS value FROM (SELECT company_id, {_structs(False, _FACT_ROWS)} AS x FROM companies)))"


def _facts(t: Tables) -> DataFrame:
    rows = t.view("companies").selectExpr("company_id", _structs(True, _FACT_ROWS))
    return rows.selectExpr(*(x.strip() for x in _split_columns(_FACT_COLUMNS)))


def _split_columns(sql: str) -> list[str]:
    out, depth = [""], 0
    for c in sql:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1]) || lower(p[2:])), '')"


def _list(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), lambda p: p <> ''), '|')"


_V = {f: f"max(CASE WHEN field = '{f}' THEN value END)" for f in _FACTS}


@query(
    f"""WITH {_FACTS_SQL}, {_ROLLED}, p AS (SELECT company_id, {', '.join(f'{e} AS {f}' for f, e in _V.items())} FROM evidence GROUP BY 1)
    SELECT company_id, legal_name, website, cin, industry, company_category, canonical_name AS normalized_name, CASE WHEN lower(trim(export_status)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(export_status)) IN ('false', '0', 'no') THEN false END AS export_status,
    {_title('trim(state)')} AS state, {_title('trim(city)')} AS city, trim(country) AS country, upper(trim(country_code)) AS country_code, {_list('products')} AS products, {_list('services')} AS services,
    TRY_CAST(trunc(TRY_CAST(employee_count AS DOUBLE)) AS INTEGER) AS employee_count, TRY_CAST(trunc(TRY_CAST(employee_range_min AS DOUBLE)) AS INTEGER) AS employee_range_min, TRY_CAST(revenue_year AS INTEGER) AS revenue_year,
    CAST(TRY_CAST(annual_revenue_inr AS DOUBLE) AS DOUBLE) AS annual_revenue_inr, CAST(TRY_CAST(incorporation_date AS DATE) AS VARCHAR) AS incorporation_date FROM p""",
    "companies", "sources",
)
def canonical_companies(t: Tables) -> DataFrame:
    """CAN, SNK-04, STR-07, STR-09: evidence of every kind of field as typed rows."""
    out = evidence.canonical(evidence.roll_up(evidence.scored(_facts(t), t.view("sources"), AS_OF)))
    out = out.withColumns({"products": F.array_join("products", "|"), "services": F.array_join("services", "|"), "annual_revenue_inr": F.col("annual_revenue_inr").cast("double"), "incorporation_date": F.col("incorporation_date").cast("string")})
    return out.select("company_id", "legal_name", "website", "cin", "industry", "company_category", "normalized_name", "export_status", "state", "city", "country", "country_code", "products", "services",
                      "employee_count", "employee_range_min", "revenue_year", "annual_revenue_inr", "incorporation_date")


@query(
    f"""WITH {_ROLLED}, voices AS (SELECT e.company_id, e.field, string_agg(voice, ' ' ORDER BY voice) AS voices FROM evidence e JOIN (SELECT s.company_id, s.field, value_key, s.verification_type || ':' ||
    CAST(w.reliability_weight AS VARCHAR) || 'x' || CAST(count(*) AS VARCHAR) AS voice FROM scored s JOIN sources w ON s.source_id = w.source_id GROUP BY s.company_id, s.field, value_key, s.verification_type, w.reliability_weight) v
    ON e.company_id = v.company_id AND e.field = v.field AND lower(trim(coalesce(e.value, ''))) = v.value_key GROUP BY 1, 2)
    SELECT company_id, field, round(best, 3) AS base_score, round(least(0.15, 0.05 * (agreeing - 1)), 3) AS bonus, round((1 - CAST(agreeing AS DOUBLE) / total) * 0.30, 3) AS penalty,
    round(CAST(agreeing AS DOUBLE) / total, 3) AS agreement, agreeing, CAST(total AS BIGINT) AS total, voices FROM evidence JOIN voices USING (company_id, field)""",
    "observations", "sources",
)
def evidence_explained(t: Tables) -> DataFrame:
    """CNF-12."""
    scores = evidence.scored(t.view("observations"), t.view("sources"), AS_OF)
    e = F.col("explanation")
    voice = F.transform(e["voices"], lambda v: F.concat(v.verification_type, F.lit(":"), v.reliability_weight.cast("string"), F.lit("x"), v.n.cast("string")))
    return evidence.explanations(scores, AS_OF).select(
        "company_id", "field", e["base_score"].alias("base_score"), e["independent_source_bonus"].alias("bonus"), e["conflict_penalty"].alias("penalty"), e["agreement_ratio"].alias("agreement"),
        e["agreeing_observation_count"].alias("agreeing"), e["total_observation_count"].alias("total"), F.array_join(F.array_sort(voice), " ").alias("voices"),
    )


@query(
    f"""WITH {_ROLLED}, wanted AS (SELECT company_id, unnest(['f1', 'f5', 'f99']) AS field FROM companies) SELECT w.company_id, w.field, value, coalesce(round(raw, 3), 0.0) AS confidence,
    coalesce(verification_type, 'unknown') AS verification_type, CASE WHEN raw IS NULL THEN 'no_observations' END AS reason FROM wanted w LEFT JOIN evidence e ON w.company_id = e.company_id AND w.field = e.field""",
    "companies", "observations", "sources",
)
def evidence_wanted(t: Tables) -> DataFrame:
    """CNF-13: fields that no observation speaks of, too."""
    wanted = t.view("companies").select("company_id", F.explode(F.array(F.lit("f1"), F.lit("f5"), F.lit("f99"))).alias("field"))
    return evidence.confidence_of(wanted, evidence.roll_up(evidence.scored(t.view("observations"), t.view("sources"), AS_OF)))


# --- searches --------------------------------------------------------------------------------------------------------------

_SAVED = G("AND", C("employees", ">=", 6), C("state", "!=", "nation_3"))


@query(
    f"SELECT company_id, state, {_NAMED.format(s=filter_sql.strength(_SAVED))} AS match_strength FROM companies WHERE country_code IN ('AM', 'AF', 'EU') AND company_id IN (SELECT company_id FROM observations "
    f"WHERE source_id IN (2, 5, 8)) AND {filter_sql.include(_SAVED)} ORDER BY state ASC NULLS LAST, company_id LIMIT 150 OFFSET 3",
    "companies", "observations",
)
def saved_search_scopes(t: Tables) -> DataFrame:
    """FLT-29, FLT-30, PRJ-05, JSN-01: a saved search within countries and sources."""
    saved = {"name": "mine", "filter_json": tree.dumps(_SAVED), "country_scope": ["AM", "AF", "EU"], "source_scope": [2, 5, 8], "sort": [["state", "asc"]], "offset": 3, "limit": 150, "selected_fields": ["company_id", "state", "match_strength"]}
    return search.run_saved(t.view("companies"), saved, t.view("observations"))


_PRODUCTS = "CASE company_id % 5 WHEN 0 THEN array('Steel Pipes', 'Bolts') WHEN 1 THEN array('steel_rod') WHEN 2 THEN array('pipe') WHEN 3 THEN array() END"


@query(
    "SELECT company_id FROM companies WHERE company_id % 5 IN (0, 1) AND lower(city) LIKE '%nation_1%' AND lower(state) LIKE '%n%' AND company_category = 'trader' AND last_verified_at >= TIMESTAMP '2000-01-01' "
    "ORDER BY confidence DESC NULLS LAST, company_id LIMIT 200",
    "companies",
)
def flat_product(t: Tables) -> DataFrame:
    """FLT-41, FLT-42, FLT-46, ARR-01: a product by its element, in any case."""
    rows = t.view("companies").withColumn("products", F.expr(_PRODUCTS.replace("array()", "cast(array() AS array<string>)")))
    f = search.FlatFilters(product="STEEL", city="nation_1", state="N", company_category="trader", last_verified_after=AS_OF.replace(year=2000), limit=200)
    return search.flat(rows, f).select("company_id")


_SHOWN = "coalesce(nullif(s.display_name, ''), s.name)"
_NAMES_SQL = f"names AS (SELECT company_id, string_agg(shown, '|' ORDER BY shown) AS sources FROM (SELECT DISTINCT o.company_id, o.source_id, {_SHOWN} AS shown FROM observations o JOIN sources s ON o.source_id = s.source_id WHERE o.source_id % 3 = 0) GROUP BY 1)"


def _names(t: Tables) -> DataFrame:
    return health.source_names(t.view("observations").filter("source_id % 3 = 0"), t.view("sources"), ["company_id"])


@query(
    f"WITH {_NAMES_SQL} SELECT c.company_id, coalesce(coalesce(employee_count, employee_range_min) >= 8, true) AS match_is_definite, coalesce(sources, '') AS sources FROM companies c LEFT JOIN names n "
    "ON c.company_id = n.company_id WHERE coalesce(employee_count, employee_range_max) >= 8",
    "companies", "observations", "sources",
)
def search_with_sources(t: Tables) -> DataFrame:
    """PRJ-02."""
    found = search.flat(t.view("companies"), search.FlatFilters(employee_min=8), page=False)
    return search.with_sources(found, _names(t)).select("company_id", "match_is_definite", F.array_join("sources", "|").alias("sources"))


_BOTH = G("AND", C("employees", ">=", 8), C("company_category", "=", "trader"))


@query(
    f"WITH {_NAMES_SQL}, m AS (SELECT company_id, {_NAMED.format(s=filter_sql.strength(_BOTH))} AS match_strength, 'results' AS bucket FROM companies WHERE {filter_sql.include(_BOTH)} UNION ALL "
    "SELECT company_id, 'unknown', 'unknown' FROM companies WHERE (employee_count IS NULL AND employee_range_min IS NULL AND employee_range_max IS NULL OR coalesce(employee_count, employee_range_max) >= 8) "
    "AND (company_category IS NULL OR company_category = 'trader') AND (company_category IS NULL OR employee_count IS NULL AND employee_range_min IS NULL AND employee_range_max IS NULL)) "
    "SELECT m.*, coalesce(sources, '') AS sources FROM m LEFT JOIN names n ON m.company_id = n.company_id",
    "companies", "observations", "sources",
)
def search_with_unknown(t: Tables) -> DataFrame:
    """PRJ-03, FLT-31."""
    found = search.with_unknown(t.view("companies"), _BOTH, _names(t), limit=None)
    return found.select("company_id", "match_strength", "bucket", F.array_join("sources", "|").alias("sources"))


def _refused(make) -> str:
    try:
        make()
    except (tree.InvalidFilterConditionError, tree.UnknownFilterFieldError, mapping.MappingError) as e:
        return type(e).__name__
    return "accepted"


_BAD, _FIELD, _MAP = "InvalidFilterConditionError", "UnknownFilterFieldError", "MappingError"
_CASES = (
    ("operator of another type", _BAD, lambda: tree.Condition("state", "BETWEEN", "string", ["a", "b"])),
    ("one value for a list", _BAD, lambda: tree.Condition("state", "IN", "string", "a")),
    ("three values between", _BAD, lambda: tree.Condition("employees", "BETWEEN", "number", [1, 2, 3])),
    ("a value for exists", _BAD, lambda: tree.Condition("state", "EXISTS", "string", "a")),
    ("unknown field", _FIELD, lambda: tree.spec_of(tree.Condition("colour", "=", "string", "a"), tree.FIELDS)),
    ("a type other than that of the field", _BAD, lambda: tree.spec_of(tree.Condition("employees", "=", "string", "a"), tree.FIELDS)),
    ("operator that the field lacks", _BAD, lambda: tree.spec_of(tree.Condition("confidence", "EXISTS", "number"), tree.FIELDS)),
    ("time by equality", _BAD, lambda: tree.spec_of(tree.Condition("last_verified_at", "=", "date", "2001-01-01"), tree.FIELDS)),
    ("empty group", _BAD, lambda: tree.Group("AND", [])),
    ("two under a not", _BAD, lambda: tree.Group("NOT", [C("state", "=", "a"), C("city", "=", "b")])),
    ("employees below 0", _BAD, lambda: search.FlatFilters(employee_min=-1)),
    ("confidence beyond 1", _BAD, lambda: search.FlatFilters(min_confidence=1.5)),
    ("page beyond 200", _BAD, lambda: search.FlatFilters(limit=201)),
    ("empty mapping", _MAP, lambda: mapping.validate({})),
    ("mapping to an unknown field", _MAP, lambda: mapping.validate({"a": "legal_name", "b": "colour"})),
    ("field mapped twice", _MAP, lambda: mapping.validate({"a": "legal_name", "b": "legal_name"})),
    ("mapping without a name", _MAP, lambda: mapping.validate({"a": "cin"})),
    ("a whole tree", "accepted", lambda: tree.loads(tree.dumps(_SAVED))),
    ("a whole mapping", "accepted", lambda: mapping.validate(_CUSTOM_MAP)),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v, _ in _CASES) + ") v(input, outcome)")
def refused_inputs(t: Tables) -> DataFrame:
    """FLT-26..28, FLT-50, MAP-04: what is refused before anything runs, and how."""
    return t.spark.createDataFrame([(k, _refused(make)) for k, _, make in _CASES], "input string, outcome string")


_FORM = [{"field": "state", "operator": "IN", "data_type": "string", "value": " nation_3 ,, Nation_5,"}, {"field": "employees", "operator": ">=", "data_type": "number", "value": "7"},
         {"field": "export_status", "operator": "=", "data_type": "boolean", "value": "TRUE "}]


@query("SELECT company_id FROM companies WHERE lower(state) IN ('nation_3', 'nation_5') AND coalesce(employee_count, employee_range_max) >= 7 AND export_status = true", "companies")
def form_rows(t: Tables) -> DataFrame:
    """FLT-51: a form's rows of text as a tree."""
    return search.advanced(t.view("companies"), tree.from_rows(_FORM), limit=None).select("company_id")


@query(
    "SELECT 'name' AS list, source_id AS id, row_number() OVER (ORDER BY name NULLS LAST, source_id) AS place FROM sources QUALIFY place <= 60 UNION ALL "
    "SELECT 'newest', job_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, job_id) AS place FROM jobs QUALIFY place <= 60 UNION ALL "
    "SELECT 'oldest', job_id, row_number() OVER (ORDER BY created_at NULLS LAST, job_id) AS place FROM jobs QUALIFY place <= 60",
    "sources", "jobs",
)
def fixed_orders(t: Tables) -> DataFrame:
    """SRT-04: the first page of each list, with places."""
    lists = (("name", projections.by_name(t.view("sources")), "source_id"), ("newest", projections.newest_first(t.view("jobs"), "created_at", "job_id"), "job_id"),
             ("oldest", projections.oldest_first(t.view("jobs"), "created_at", "job_id"), "job_id"))
    out = None
    for name, rows, key in lists:
        page = rows.limit(60).agg(F.collect_list(key).alias("ids"))  # of a fixed size
        part = page.select(F.posexplode("ids").alias("p", "id")).select(F.lit(name).alias("list"), F.col("id").cast("bigint").alias("id"), (F.col("p") + 1).cast("bigint").alias("place"))
        out = part if out is None else out.union(part)
    return out


# --- resolution by name ------------------------------------------------------------------------------------------------------


def _lcs(pairs: str, known: str = "") -> str:
    """CTEs: token-sort similarity of the (a, b) in ``pairs``, row by row of the usual table."""
    tokens = "array_to_string(list_sort(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')), ' ')"
    return f"""sorted AS (SELECT DISTINCT a, b, {tokens.format(x='a')} AS x, {tokens.format(x='b')} AS y FROM {pairs}),
  steps AS (SELECT a, b, x, y, 0 AS i, list_transform(range(0, CAST(length(y) + 1 AS BIGINT)), lambda z: CAST(0 AS BIGINT)) AS above FROM sorted UNION ALL
  SELECT a, b, x, y, i + 1, list_transform(range(0, CAST(length(y) + 1 AS BIGINT)), lambda j: CASE WHEN j = 0 THEN CAST(0 AS BIGINT) ELSE list_max(list_transform(range(1, j + 1), lambda k: greatest(above[k + 1],
  CASE WHEN substr(y, k, 1) = substr(x, i + 1, 1) THEN above[k] + 1 ELSE 0 END))) END) FROM steps WHERE i < length(x)),
  alike AS (SELECT a, b, CASE WHEN x = '' OR y = '' THEN 0.0 ELSE 2.0 * above[len(above)] / (length(x) + length(y)) END AS ratio FROM steps WHERE i = length(x))"""


@query(f"WITH RECURSIVE {_TRIGRAMS}, asked AS (SELECT left_name AS a, right_name AS b FROM pairs WHERE similarity > 0.3), {_lcs('asked')} SELECT a AS left_name, b AS right_name, round(ratio, 4) AS similarity FROM alike")
def er_token_sort(t: Tables) -> DataFrame:
    """STR-13 over the pairs that trigrams find."""
    names = t.table("part").select(F.col("p_name").alias("name"))
    pairs = resolution.similar_pairs(names, names)
    return pairs.select("left_name", "right_name", F.round(text.token_sort_similarity(F.col("left_name"), F.col("right_name")), 4).alias("similarity"))


_BEST = """r AS (SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 4 = 0 THEN concat('CIN', CAST(s_suppkey AS VARCHAR)) END AS cin, CASE WHEN s_suppkey % 5 = 0 THEN concat('G', CAST(s_suppkey AS VARCHAR)) END AS gstin,
  concat('host', CAST(s_suppkey % 60 AS VARCHAR), '.example') AS domain, s_name AS name, CAST(s_nationkey AS VARCHAR) AS state FROM supplier),
  c AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 2 = 0 THEN concat('CIN', CAST(c_custkey AS VARCHAR)) END AS cin, CASE WHEN c_custkey % 3 = 0 THEN concat('G', CAST(c_custkey AS VARCHAR)) END AS gstin,
  CASE WHEN c_custkey % 10 = 0 THEN concat('host', CAST(c_custkey AS VARCHAR), '.example') END AS domain, c_name AS name, CAST(c_nationkey AS VARCHAR) AS state FROM customer),
  words AS (SELECT name, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS w FROM (SELECT name FROM r UNION SELECT name FROM c)),
  pieces AS (SELECT DISTINCT name, unnest(list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substr('  ' || w || ' ', i, 3))) AS piece FROM words WHERE w <> ''),
  sizes AS (SELECT name, count(*) AS n FROM pieces GROUP BY 1),
  near AS (SELECT x.name AS a, y.name AS b, count(*) / CAST(any_value(m.n) + any_value(o.n) - count(*) AS DOUBLE) AS similarity FROM pieces x JOIN pieces y ON x.piece = y.piece JOIN sizes m ON x.name = m.name
  JOIN sizes o ON y.name = o.name WHERE x.name IN (SELECT name FROM r) AND y.name IN (SELECT name FROM c) GROUP BY 1, 2 HAVING similarity > 0.3),
  exact AS (SELECT record_id, company_id, 0 AS kind, NULL AS similarity FROM r JOIN c ON r.cin = c.cin OR r.gstin = c.gstin OR r.domain = c.domain QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY company_id) <= 10),
  fuzzy AS (SELECT record_id, company_id, 1 AS kind, similarity FROM near JOIN r ON near.a = r.name JOIN c ON near.b = c.name QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY similarity DESC, company_id) <= 10),
  found AS (SELECT record_id, company_id, min(kind) AS kind, max(similarity) AS similarity FROM (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy) GROUP BY 1, 2),
  asked AS (SELECT r.name AS a, c.name AS b FROM found JOIN r USING (record_id) JOIN c USING (company_id)), """ + _lcs("asked") + """,
  judged AS (SELECT f.*, greatest(CASE WHEN r.cin = c.cin THEN 1.0 ELSE 0 END, CASE WHEN r.gstin = c.gstin THEN 0.95 ELSE 0 END, CASE WHEN r.domain = c.domain THEN 0.75 ELSE 0 END,
  CASE WHEN ratio >= 0.98 THEN CASE WHEN r.state = c.state THEN 0.75 ELSE 0.55 END WHEN ratio >= 0.85 THEN CASE WHEN r.state = c.state THEN 0.65 ELSE 0.30 END ELSE 0 END) AS score
  FROM found f JOIN r USING (record_id) JOIN c USING (company_id) JOIN alike ON alike.a = r.name AND alike.b = c.name),
  best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, kind, similarity DESC NULLS LAST, company_id) = 1),
  resolved AS (SELECT r.record_id, company_id, r.name, CAST(round(coalesce(score, 0.0), 4) AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'auto_match' WHEN score >= 0.5 THEN 'review' ELSE 'no_match' END AS decision FROM r LEFT JOIN best USING (record_id))"""


@query(f"WITH RECURSIVE {_BEST} SELECT record_id, company_id, score, decision FROM resolved")
def er_best_candidate(t: Tables) -> DataFrame:
    """ER-03..07, JN-07, WIN-05/06, SRT-05, SET-01 with names."""
    records, companies = _signals(t)
    return resolution.resolve(records, companies).select("record_id", "company_id", F.round("score", 4).alias("score"), "decision")


_OUTCOME = "CASE decision WHEN 'auto_match' THEN 'attach' WHEN 'review' THEN 'queue' ELSE CASE WHEN name <> '' THEN 'create' ELSE 'drop' END END"


@query(f"WITH RECURSIVE {_BEST} SELECT record_id, decision, {_OUTCOME} AS outcome, CASE WHEN {_OUTCOME} = 'create' THEN sha256('company|' || CAST(record_id AS VARCHAR)) END AS new_company_id FROM resolved")
def er_decisions(t: Tables) -> DataFrame:
    """ER-08, ER-09: every record's outcome and new company."""
    records, companies = _signals(t)
    return resolution.outcomes(resolution.resolve(records, companies)).select("record_id", "decision", "outcome", "new_company_id")


_OWN = {"cin": "CASE WHEN c_custkey % 10 = 0 THEN concat('c', c_custkey % 100) END", "gstin": "concat('g', CAST(floor((c_custkey + 1) / 2) AS INT))", "domain": "concat('d', CAST(floor(c_custkey / 2) AS INT))"}


@query(
    "WITH RECURSIVE r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN concat('C', c_custkey % 100) END AS cin, (c_custkey + 1) // 2 AS gstin, c_custkey // 2 AS domain FROM customer), "
    "found AS (SELECT x.k AS later, y.k AS earlier, greatest(CASE WHEN x.cin = y.cin THEN 1.0 ELSE 0 END, CASE WHEN x.gstin = y.gstin THEN 0.95 ELSE 0 END, CASE WHEN x.domain = y.domain THEN 0.75 ELSE 0 END) AS score "
    "FROM r x JOIN r y ON x.cin = y.cin OR x.gstin = y.gstin OR x.domain = y.domain QUALIFY row_number() OVER (PARTITION BY x.k ORDER BY y.k) <= 10), "
    "edges AS (SELECT * FROM found WHERE earlier < later), "
    "arrived AS (SELECT r.k, row_number() OVER (ORDER BY r.k) AS n, coalesce(list(earlier) FILTER (WHERE earlier IS NOT NULL), []) AS before FROM r LEFT JOIN edges ON later = r.k GROUP BY r.k), "
    "fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS new UNION ALL SELECT a.n, CASE WHEN list_has_any(f.new, a.before) THEN f.new ELSE list_append(f.new, a.k) END FROM fold f JOIN arrived a ON a.n = f.n + 1), "
    "firsts AS (SELECT unnest(new) AS k FROM (SELECT new FROM fold ORDER BY n DESC LIMIT 1)), "
    "best AS (SELECT later, earlier, score FROM edges JOIN firsts ON firsts.k = earlier QUALIFY row_number() OVER (PARTITION BY later ORDER BY score DESC, earlier) = 1) "
    "SELECT r.k AS record_id, CASE WHEN f.k IS NOT NULL THEN r.k ELSE earlier END AS into_id, CASE WHEN f.k IS NULL THEN CAST(score AS DOUBLE) END AS score "
    "FROM r LEFT JOIN firsts f ON f.k = r.k LEFT JOIN best ON later = r.k"
)
def er_own_batch(t: Tables) -> DataFrame:
    """ER-09: a batch resolved against itself, in order of arrival; each customer shares a number with the one before, so that one chain
    runs through them all."""
    made = t.table("customer").selectExpr("c_custkey AS record_id", *(f"{e} AS {n}" for n, e in _OWN.items()), *(f"CAST(NULL AS STRING) AS {n}" for n in ("name", "state", "postal", "email_domain")))
    out = ingest.among_themselves(resolution.folded(made, "record_id"))
    return out.select("record_id", F.col("into").alias("into_id"), "score")


@query(
    f"WITH RECURSIVE {_BEST} SELECT count(*) FILTER (WHERE o = 'create') AS new_companies, count(*) FILTER (WHERE o = 'attach') AS existing_companies, count(*) FILTER (WHERE o = 'queue') AS ambiguous_matches, "
    f"count(*) FILTER (WHERE o = 'drop') AS no_match, (SELECT count(*) FROM part WHERE p_partkey % 9 = 0) AS parsing_failures FROM (SELECT {_OUTCOME} AS o FROM resolved)"
)
def import_decisions(t: Tables) -> DataFrame:
    """AGG-09: what became of an import's records."""
    records, companies = _signals(t)
    return resolution.decision_counts(resolution.resolve(records, companies), t.table("part").filter("p_partkey % 9 = 0"))


_RULE = {
    "cin": ("CASE WHEN k % 11 = 0 THEN concat('c', k) END", "CASE WHEN k % 22 = 0 THEN concat('C', k, ' ') ELSE 'Z' END"),
    "gstin": ("CASE WHEN k % 13 = 0 THEN concat('g', k) END", "CASE WHEN k % 2 = 0 THEN concat('G', k) END"),
    "domain": ("CASE WHEN k % 7 = 0 THEN concat('D', k) END", "concat('d', k)"),
    "name": ("CASE k % 5 WHEN 0 THEN concat('alpha beta ', k) WHEN 1 THEN concat(k, ' beta  alpha') WHEN 2 THEN concat('alpha betta ', k) WHEN 3 THEN concat('gamma ', k) END", "concat('alpha beta ', k)"),
    "state": ("CASE WHEN k % 3 = 0 THEN 'goa ' WHEN k % 3 = 1 THEN 'Pune' END", "'Goa'"),
    "postal": ("CASE WHEN k % 4 = 0 THEN '411001' ELSE '' END", "'411001'"),
    "email_domain": ("CASE WHEN k % 17 = 0 THEN 'Mail.example' END", "'mail.example'"),
}
_FOLD = {"cin": "upper(trim({x}))", "gstin": "upper(trim({x}))", "domain": "lower(trim({x}))", "state": "lower(trim({x}))", "email_domain": "lower(trim({x}))", "name": "{x}", "postal": "{x}"}


def _rule_sql(side: int, key: str, table: str) -> str:
    made = ", ".join(f"nullif({_FOLD[n].format(x=e[side])}, '') AS {n}" for n, e in _RULE.items())
    return f"SELECT k, {made} FROM (SELECT {key} AS k FROM {table})"


_SAYS = {n: f"r.{n} = c.{n}" for n in ("cin", "gstin", "domain", "email_domain", "state", "postal")}


@query(
    f"WITH RECURSIVE r AS ({_rule_sql(0, 's_suppkey', 'supplier')}), c AS ({_rule_sql(1, 'c_custkey', 'customer')}), asked AS (SELECT r.name AS a, c.name AS b FROM r JOIN c ON r.k = c.k WHERE r.name IS NOT NULL), {_lcs('asked')}, "
    f"j AS (SELECT r.k AS record_id, {', '.join(f'{e} AS {n}' for n, e in _SAYS.items())}, ratio FROM r JOIN c ON r.k = c.k LEFT JOIN alike ON alike.a = r.name AND alike.b = c.name), "
    "s AS (SELECT *, coalesce(state, false) OR coalesce(postal, false) AS placed FROM j), "
    "t AS (SELECT *, greatest(CASE WHEN cin THEN 1.0 ELSE 0 END, CASE WHEN gstin THEN 0.95 ELSE 0 END, CASE WHEN domain THEN 0.75 ELSE 0 END, CASE WHEN email_domain THEN 0.60 ELSE 0 END, "
    "CASE WHEN ratio >= 0.98 THEN CASE WHEN placed THEN 0.75 ELSE 0.55 END WHEN ratio >= 0.85 THEN CASE WHEN placed THEN 0.65 ELSE 0.30 END ELSE 0 END) AS score FROM s) "
    "SELECT record_id, cin, gstin, domain, email_domain, state, postal, round(ratio, 4) AS name_similarity, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'auto_match' WHEN score >= 0.5 THEN 'review' ELSE 'no_match' END AS decision FROM t"
)
def er_rule_table(t: Tables) -> DataFrame:
    """ER-01, ER-04..06: every rule, with the signals that say so."""
    sides = []
    for side, key, of in ((0, "s_suppkey", "supplier"), (1, "c_custkey", "customer")):
        rows = t.table(of).selectExpr(f"{key} AS k").selectExpr("k", *(f"{e[side]} AS {n}" for n, e in _RULE.items()))
        name = ("record_id", "company_id")[side]
        sides.append(resolution.folded(rows.withColumnRenamed("k", name), name))
    records, companies = sides
    pairs = records.select("record_id").join(companies.select("company_id"), F.col("record_id") == F.col("company_id"))
    out = resolution.scored(pairs, records, companies)
    return out.select("record_id", *(F.col(f"signals.{n}").alias(n) for n in _SAYS), F.round("signals.name_similarity", 4).alias("name_similarity"), "score", "decision")


@query(
    "WITH q AS (SELECT obs_id, company_id FROM observations WHERE company_id % 3 = 0 AND field = 'f1'), s AS (SELECT o.source_id, o.collected_at, arg_min(q.company_id, q.obs_id) AS company_id FROM q "
    "JOIN observations o ON q.obs_id = o.obs_id GROUP BY 1, 2) SELECT o.obs_id, s.company_id FROM (SELECT obs_id, source_id, collected_at FROM observations WHERE field <> 'f1') o "
    "JOIN s ON o.source_id = s.source_id AND o.collected_at = s.collected_at",
    "observations",
)
def confirmed_siblings(t: Tables) -> DataFrame:
    """JN-10, ER-10: what a confirmed candidate's source said at that time, as far as it is unattached."""
    rows = t.view("observations")
    chosen = rows.filter("company_id % 3 = 0 AND field = 'f1'").select("obs_id", "company_id")
    open_ = rows.withColumn("company_id", F.when(F.col("field") == "f1", F.col("company_id")))
    return ingest.siblings(chosen, open_).select("obs_id", "company_id")


@query(
    "SELECT sha256('company|' || CAST(s_suppkey AS VARCHAR)) AS company_id, name AS canonical_name, upper(trim(cin)) AS cin, "
    f"{_title('lower(trim(state))')} AS state, postal AS postal_code, name AS alias, 0.0 AS confidence, 0 AS source_count FROM (SELECT s_suppkey, concat('c', CAST(s_suppkey AS VARCHAR)) AS cin, "
    "CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, 'tamil-nadu x' AS state, '411001' AS postal FROM supplier)"
)
def created_companies(t: Tables) -> DataFrame:
    """SNK-03, ER-09, STR-07: new companies' first rows, and the names under which they came."""
    rows = t.table("supplier").selectExpr(
        "s_suppkey AS record_id", "concat('c', s_suppkey) AS cin", "CAST(NULL AS STRING) AS gstin", "CAST(NULL AS STRING) AS domain", "CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name",
        "' Tamil-NADU x' AS state", "'411001' AS postal", "CAST(NULL AS STRING) AS email_domain",
    )
    folded = resolution.folded(rows, "record_id")
    out = ingest.stubs(folded).join(ingest.aliases(folded).select("company_id", "alias"), "company_id", "left")
    return out.select("company_id", "canonical_name", "cin", "state", "postal_code", "alias", "confidence", "source_count")


@query("SELECT company_id FROM (SELECT DISTINCT company_id FROM observations WHERE source_id IN (1, 2, 3)) WHERE company_id IS NOT NULL", "observations")
def touched_companies(t: Tables) -> DataFrame:
    """SET-03."""
    return ingest.touched(t.view("observations").filter(F.col("source_id").isin(1, 2, 3)))


_CALLS = "SELECT source_id, job_id AS call_id, epoch_us(created_at) AS micros, row_number() OVER (PARTITION BY source_id ORDER BY created_at, job_id) AS n FROM jobs"


@query(
    f"""WITH RECURSIVE calls AS ({_CALLS}), fold AS (SELECT source_id, call_id, n, true AS allowed, micros AS latest FROM calls WHERE n = 1 UNION ALL
    SELECT c.source_id, c.call_id, c.n, c.micros - f.latest >= 60000000, CASE WHEN c.micros - f.latest >= 60000000 THEN c.micros ELSE f.latest END FROM fold f JOIN calls c ON c.source_id = f.source_id AND c.n = f.n + 1)
    SELECT source_id, call_id, allowed FROM fold""",
    "jobs",
)
def rate_limited_calls(t: Tables) -> DataFrame:
    """WIN-08, STM-04: at one call a minute, the last allowed one decides; more are tested against the plain loop."""
    calls = t.view("jobs").select("source_id", F.col("created_at").alias("at"), F.lit(1).alias("limit_per_minute"), F.col("job_id").alias("call_id"))
    return health.allowed_calls(calls)


_URLS = {
    "http://192.168.0.1/x": False, "https://Example.com:8080/a": True, "ftp://example.com": False, "https://u:p@example.com": False, "http://2130706433/": False, "http://0x7f000001/": False, "http://134744072/": True,
    "http://[::1]/": False, "http://[2606:4700::1111]/": True, "http://[fe80::1]:80/": False, "http://[2001:db8::1]/": False, "http://172.31.9.9/": False, "http://172.32.9.9/": True, "http://": False, "nothing": False,
}


@query(
    "SELECT job_id, CASE CAST(job_id % " + str(len(_URLS)) + " AS INTEGER) " + " ".join(f"WHEN {i} THEN {str(v).lower()}" for i, v in enumerate(_URLS.values())) + " END AS safe FROM jobs", "jobs"
)
def url_safety(t: Tables) -> DataFrame:
    """STR-15: hosts of both versions, in numbers too."""
    urls = F.array(*(F.lit(u) for u in _URLS))
    return t.view("jobs").select("job_id", text.safe_url(F.get(urls, (F.col("job_id") % len(_URLS)).cast("int"))).alias("safe"))


