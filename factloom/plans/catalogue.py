"""Every registered query over the driver's tables, with its DuckDB twin. Names carry on the inventory's."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text, values
from factloom.operators import evidence, filter_tree as tree, health, projections, resolution, search
from factloom.plans import filter_sql
from factloom.plans.bridge import Tables, duckdb
from factloom.sources import adapters, mapping, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2002, 1, 1)


def query(sql: str | None = None, *views: str, name: str | None = None) -> Callable:
    """Registers a function of Tables, with what the other engine runs."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[key] = duckdb(sql, *views)
        return f

    return add


def C(field: str, op: str, value: object = None) -> tree.Condition:
    return tree.Condition(field, op, tree.FIELDS[field].kind, value)


def G(op: str, *conditions: tree.Node) -> tree.Group:
    return tree.Group(op, list(conditions))


# --- filters: each tree with its strength -------------------------------------------------------------------------

FLAGSHIP = G("AND", C("industry", "=", "building"), C("employees", ">=", 8), C("revenue_inr", ">=", 2_500_000))
TREES: dict[str, tree.Node] = {
    "flt_string_ops": G("OR", C("industry", "=", "building"), C("state", "STARTS_WITH", "nation_2"), C("canonical_name", "CONTAINS", "00%1"), C("state", "CONTAINS", "N_1")),
    "flt_string_not_equal": C("city", "!=", "Nation_3"),
    "flt_string_in": G("AND", C("state", "IN", ["nation_3", "NATION_4", "Nation_5"]), C("city", "NOT_IN", ["Nation_5"])),
    "flt_enum_ops": G("OR", C("company_category", "=", "trader"), C("company_category", "IN", ["Manufacturer", "service_provider"])),
    "flt_enum_not": G("AND", C("company_category", "!=", "trader"), C("company_category", "NOT_IN", ["manufacturer"])),
    "flt_boolean_ops": G("OR", C("export_status", "=", True), G("AND", C("export_status", "!=", True), C("industry", "=", "machinery"))),
    "flt_date_ops": G("OR", C("incorporation_date", "<", "1995-02-01"), C("incorporation_date", ">=", "1996-06-01"), C("incorporation_date", "=", "1995-05-05")),
    "flt_date_not_equal": C("incorporation_date", "!=", "1995-01-01"),
    "flt_date_between": C("incorporation_date", "BETWEEN", ["1995-03-01", "1995-06-30"]),
    "flt_timestamp_order": G("AND", C("last_verified_at", ">", "2001-01-01"), C("last_verified_at", "<=", "2001-07-15")),
    "flt_numeric_exact": G("OR", C("confidence", "=", 0.25), C("confidence", ">", 0.9), C("confidence", "<=", 0.05)),
    "flt_numeric_not_equal": C("confidence", "!=", 0.5),
    "flt_range_equal": C("employees", "=", 10),
    "flt_range_not_equal": C("employees", "!=", 10),
    "flt_range_greater": C("employees", ">", 11),
    "flt_range_at_least": C("employees", ">=", 11),
    "flt_range_less": C("employees", "<", 9),
    "flt_range_at_most": C("employees", "<=", 9),
    "flt_between_overlap": C("revenue_inr", "BETWEEN", [1_500_000, 2_600_000]),
    "flt_in_range": C("employees", "IN", [7, 10, 13]),
    "flt_not_in_range": C("employees", "NOT_IN", [7, 10]),
    "flt_exists_range": C("employees", "EXISTS"),
    "flt_not_exists_range": C("revenue_inr", "NOT_EXISTS"),
    "flt_exists_plain": G("OR", C("company_category", "NOT_EXISTS"), C("city", "EXISTS")),
    "flt_and_or_not_nested": G("AND", G("OR", C("employees", ">=", 10), C("revenue_inr", "<", 2_000_000)), G("NOT", G("AND", C("state", "=", "nation_3"), C("employees", "<", 12)))),
    "flt_not_guard_nulls": G("NOT", C("city", "!=", "nation_3")),
    "flt_not_range": G("NOT", C("employees", ">=", 10)),
    "flt_single_groups": G("AND", G("OR", C("employees", ">", 12))),
}


def _tree(key: str, node: tree.Node) -> None:
    sql = f"SELECT company_id, {filter_sql.strength(node)} AS strength FROM companies WHERE {filter_sql.include(node)}"

    @query(sql, "companies", name=key)
    def run(t: Tables) -> DataFrame:
        return tree.annotate(t.view("companies"), node).select("company_id", "strength")


for _key, _node in TREES.items():
    _tree(_key, _node)

_NAMED = "CASE {s} WHEN 3 THEN 'definite' WHEN 2 THEN 'possible' ELSE 'unknown' END"


@query(
    f"SELECT company_id, {_NAMED.format(s=filter_sql.strength(FLAGSHIP))} AS match_strength, confidence FROM companies WHERE {filter_sql.include(FLAGSHIP)}",
    "companies",
)
def search_strength(t: Tables) -> DataFrame:
    """The flagship: every match, named by its strength."""
    return search.advanced(t.view("companies"), FLAGSHIP, limit=None).select("company_id", "match_strength", "confidence")


@query(
    f"SELECT company_id, 'definite' AS match_strength FROM companies WHERE {filter_sql.include(FLAGSHIP)} AND {filter_sql.strength(FLAGSHIP)} = 3 "
    "ORDER BY coalesce(employee_count, employee_range_min) DESC NULLS LAST, state ASC NULLS LAST, company_id LIMIT 20 OFFSET 5",
    "companies",
)
def flt_definite_only_page(t: Tables) -> DataFrame:
    sort = [("employees", "desc"), ("state", "asc")]
    found = search.advanced(t.view("companies"), FLAGSHIP, sort=sort, handling=search.DEFINITE_ONLY, offset=5, limit=20)
    return found.select("company_id", "match_strength")


_BUCKET = G("AND", C("state", "!=", "x"), C("employees", ">=", 8), C("company_category", "=", "trader"))


@query(
    "SELECT company_id FROM companies WHERE (state IS NULL OR (state IS NOT NULL AND lower(state) <> 'x')) "
    "AND ((employee_count IS NULL AND employee_range_min IS NULL AND employee_range_max IS NULL) OR coalesce(employee_count, employee_range_max) >= 8) "
    "AND (company_category IS NULL OR company_category = 'trader') AND (state IS NULL OR company_category IS NULL OR "
    "(employee_count IS NULL AND employee_range_min IS NULL AND employee_range_max IS NULL))",
    "companies",
)
def flt_unknown_bucket(t: Tables) -> DataFrame:
    return search.unknown_bucket(t.view("companies"), _BUCKET, limit=None).select("company_id")


@query("SELECT company_id, state FROM companies WHERE country_code IN ('EU', 'AS')", "companies")
def flt_scope_country(t: Tables) -> DataFrame:
    return search.in_scope(t.view("companies"), "company_id", countries=["EU", "AS"]).select("company_id", "state")


@query("SELECT company_id FROM companies WHERE company_id IN (SELECT company_id FROM observations WHERE source_id IN (3, 7))", "companies", "observations")
def flt_scope_source_semi(t: Tables) -> DataFrame:
    return search.in_scope(t.view("companies"), "company_id", observations=t.view("observations"), sources=[3, 7]).select("company_id")


@query(
    "SELECT company_id, coalesce(coalesce(employee_count, employee_range_min) >= 8, true) AND coalesce(coalesce(annual_revenue_inr, revenue_range_max_inr) <= 3000000, true) "
    "AS match_is_definite FROM companies WHERE lower(industry) LIKE '%i%g' AND coalesce(employee_count, employee_range_max) >= 8 "
    "AND coalesce(annual_revenue_inr, revenue_range_min_inr) <= 3000000",
    "companies",
)
def search_flat_definite_flag(t: Tables) -> DataFrame:
    f = search.FlatFilters(industry="i%g", employee_min=8, revenue_max_inr=3_000_000)
    return search.flat(t.view("companies"), f, page=False).select("company_id", "match_is_definite")


@query(
    "SELECT company_id FROM companies WHERE confidence >= 0.2 AND incorporation_date >= DATE '1995-02-01' AND incorporation_date < DATE '1996-01-01' AND export_status = true "
    "AND EXISTS (SELECT 1 FROM observations o WHERE o.company_id = companies.company_id AND o.verification_type = 'verified') ORDER BY confidence DESC NULLS LAST, company_id LIMIT 200",
    "companies", "observations",
)
def search_flat_verification_semi(t: Tables) -> DataFrame:
    f = search.FlatFilters(
        min_confidence=0.2, incorporated_after=datetime(1995, 2, 1).date(), incorporated_before=datetime(1996, 1, 1).date(), export_status=True,
        verification_type="verified", limit=200,
    )
    return search.flat(t.view("companies"), f, t.view("observations")).select("company_id")


@query(
    "SELECT company_id, row_number() OVER (ORDER BY company_category ASC NULLS LAST, coalesce(annual_revenue_inr, revenue_range_min_inr) DESC NULLS LAST, company_id) AS place "
    "FROM companies QUALIFY place <= 150",
    "companies",
)
def sort_effective_value(t: Tables) -> DataFrame:
    """SRT-01, SRT-03: a top-k report, with each row's place."""
    top = t.view("companies").orderBy(*tree.compile_sort([("company_category", "asc"), ("revenue_inr", "desc")], "company_id")).limit(150)
    rows = top.agg(F.collect_list("company_id").alias("ids"))  # the page itself, of a fixed size
    return rows.select(F.posexplode("ids").alias("place", "company_id")).select("company_id", (F.col("place") + 1).cast("bigint").alias("place"))


@query(
    f"SELECT company_id, {_NAMED.format(s=filter_sql.strength(TREES['flt_range_greater']))} AS match_strength FROM companies "
    f"WHERE country_code IN ('AM', 'AF') AND {filter_sql.include(TREES['flt_range_greater'])} ORDER BY state ASC NULLS LAST, company_id LIMIT 30",
    "companies",
)
def json_filter_saved_search(t: Tables) -> DataFrame:
    saved = {"filter_json": tree.dumps(TREES["flt_range_greater"]), "country_scope": ["AM", "AF"], "sort": [["state", "asc"]], "limit": 30}
    return search.run_saved(t.view("companies"), saved).select("company_id", "match_strength")


# --- functions ----------------------------------------------------------------------------------------------------

_NAME = """concat(CASE company_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'The ' ELSE '' END, canonical_name, CASE company_id % 9 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' PRIVATE LIMITED'
  WHEN 2 THEN ' & Alloys LLP' WHEN 3 THEN ', Inc.' WHEN 4 THEN '   Metals   Corp  ' WHEN 5 THEN ' Limited Co' WHEN 6 THEN '.Company' WHEN 7 THEN ' O''Neil-Works' ELSE '' END)"""
_SUFFIXES = "limited liability partnership|private limited|public limited|pvt limited|incorporated|corporation|pvt\\. ltd\\.|pvt ltd|limited|company|corp|llp|ltd|inc|co"


@query(
    f"""SELECT company_id, trim(regexp_replace(regexp_replace(lower(CASE WHEN trim(bare) = '' THEN trim(name) ELSE trim(bare) END), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized
    FROM (SELECT company_id, name, regexp_replace(name, '(?i)[\\s,.]*\\b({_SUFFIXES})\\.?\\s*$', '') AS bare FROM (SELECT company_id, {_NAME} AS name FROM companies))""",
    "companies",
)
def norm_company_name(t: Tables) -> DataFrame:
    return t.view("companies").select("company_id", text.normalize_company_name(F.expr(_NAME)).alias("normalized"))


@query(
    "SELECT page_id, nullif(regexp_replace(lower(regexp_extract(CASE WHEN page_id % 5 = 0 THEN concat('http://', replace(replace(url, 'https://', ''), 'http://', '')) ELSE url END, "
    "'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '') AS domain FROM pages"
)
def norm_domain(t: Tables) -> DataFrame:
    bare = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return t.table("pages").select("page_id", text.normalize_domain(bare).alias("domain"))


@query("SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g'))) AS digest FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\xFF]')")
def norm_whitespace(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query(
    "SELECT job_id, nullif(regexp_extract(address, '\\b(\\d{6})\\b', 1), '') AS postal_code FROM (SELECT job_id, concat('Plot ', CAST(job_id AS VARCHAR), ', Pune ', "
    "CAST(400000 + job_id AS VARCHAR), CASE WHEN job_id % 3 = 0 THEN '9' ELSE ', India' END) AS address FROM jobs)",
    "jobs",
)
def norm_postal(t: Tables) -> DataFrame:
    address = "concat('Plot ', CAST(job_id AS STRING), ', Pune ', CAST(400000 + job_id AS STRING), CASE WHEN job_id % 3 = 0 THEN '9' ELSE ', India' END)"
    return t.view("jobs").select("job_id", text.extract_postal_code(F.expr(address)).alias("postal_code"))


_MONEY = "CASE job_id % 6 WHEN 0 THEN '1,234.50' WHEN 1 THEN '-5' WHEN 2 THEN ' 7 ' WHEN 3 THEN '1e3' WHEN 4 THEN 'N.A.' ELSE concat(CAST(job_id AS VARCHAR(20)), '.') END"


@query(
    f"SELECT job_id, CASE WHEN regexp_matches(bare, '^(\\d+\\.?\\d*|\\.\\d+)$') THEN bare END AS cleaned FROM (SELECT job_id, trim(replace({_MONEY}, ',', '')) AS bare FROM jobs)",
    "jobs",
)
def norm_numeric(t: Tables) -> DataFrame:
    return t.view("jobs").select("job_id", values.clean_number(F.expr(_MONEY)).alias("cleaned"))


_SIZE = """CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) WHEN 1 THEN concat(CAST(p_size AS VARCHAR(9)), '-', CAST(p_size * 4 AS VARCHAR(9)), ' employees')
  WHEN 2 THEN concat(CAST(p_size * 100 AS VARCHAR(9)), '+ employees') WHEN 3 THEN concat('~', CAST(p_size AS VARCHAR(9)), ' employees') WHEN 4 THEN '1,200 to 800'
  WHEN 5 THEN 'many' ELSE '' END"""


@query(
    f"""SELECT p_partkey, CASE WHEN pair THEN NULL WHEN more THEN NULL WHEN one THEN n1 END AS employee_count,
    CASE WHEN pair THEN least(lo, hi) WHEN more THEN n2 WHEN one THEN n1 END AS range_min, CASE WHEN pair THEN greatest(lo, hi) WHEN more THEN NULL WHEN one THEN n1 END AS range_max
    FROM (SELECT p_partkey, regexp_matches(x, '\\d[\\d,]*\\s*[-to]{{1,3}}\\s*\\d[\\d,]*') AS pair, regexp_matches(x, '\\d[\\d,]*\\s*\\+') AS more, regexp_matches(x, '\\d') AS one,
    TRY_CAST(replace(regexp_extract(x, '(\\d[\\d,]*)\\s*[-to]{{1,3}}\\s*(\\d[\\d,]*)', 1), ',', '') AS BIGINT) AS lo,
    TRY_CAST(replace(regexp_extract(x, '(\\d[\\d,]*)\\s*[-to]{{1,3}}\\s*(\\d[\\d,]*)', 2), ',', '') AS BIGINT) AS hi,
    TRY_CAST(replace(regexp_extract(x, '(\\d[\\d,]*)', 1), ',', '') AS BIGINT) AS n1, TRY_CAST(replace(regexp_extract(x, '(\\d[\\d,]*)\\s*\\+', 1), ',', '') AS BIGINT) AS n2
    FROM (SELECT p_partkey, {_SIZE} AS x FROM part))"""
)
def norm_employee_range(t: Tables) -> DataFrame:
    size = values.employee_range(F.expr(_SIZE))
    return t.table("part").select("p_partkey", size["count"].alias("employee_count"), size["range_min"].alias("range_min"), size["range_max"].alias("range_max"))


_REVENUE = """CASE p_partkey % 8 WHEN 0 THEN concat('₹', CAST(p_size AS VARCHAR(9)), ' crore') WHEN 1 THEN concat('Rs. ', CAST(p_size AS VARCHAR(9)), '.5 lakh')
  WHEN 2 THEN concat(CAST(p_size AS VARCHAR(9)), '-', CAST(p_size + 40 AS VARCHAR(9)), ' crore') WHEN 3 THEN '10 to 50 Million' WHEN 4 THEN '12,80,00,000'
  WHEN 5 THEN 'about 3 k' WHEN 6 THEN 'unknown' ELSE '9 bn - 2 bn' END"""
_A, _U = "([\\d,]*\\d[\\d,]*(?:\\.\\d+)?)", "(crores?|cr|lakhs?|lacs?|million|mn|m|billion|bn|thousand|k)"
_TIMES = "CASE {u} WHEN 'crore' THEN 10000000 WHEN 'crores' THEN 10000000 WHEN 'cr' THEN 10000000 WHEN 'lakh' THEN 100000 WHEN 'lakhs' THEN 100000 WHEN 'lac' THEN 100000 WHEN 'lacs' THEN 100000 WHEN 'million' THEN 1000000 WHEN 'mn' THEN 1000000 WHEN 'm' THEN 1000000 WHEN 'billion' THEN 1000000000 WHEN 'bn' THEN 1000000000 WHEN 'thousand' THEN 1000 WHEN 'k' THEN 1000 ELSE 1 END"


@query(
    f"""SELECT p_partkey, CASE WHEN NOT pair AND one THEN v * {_TIMES.format(u='vu')} END AS value_inr, CASE WHEN pair THEN least(lo, hi) * times END AS range_min_inr,
    CASE WHEN pair THEN greatest(lo, hi) * times END AS range_max_inr FROM (SELECT *, {_TIMES.format(u='last_unit')} AS times FROM (
    SELECT p_partkey, regexp_matches(x, '{_A}\\s*{_U}?\\s*[-to]{{1,3}}\\s*{_A}') AS pair, regexp_matches(x, '\\d') AS one,
    TRY_CAST(replace(regexp_extract(x, '{_A}\\s*{_U}?\\s*[-to]{{1,3}}\\s*{_A}', 1), ',', '') AS DOUBLE) AS lo,
    TRY_CAST(replace(regexp_extract(x, '{_A}\\s*{_U}?\\s*[-to]{{1,3}}\\s*{_A}', 3), ',', '') AS DOUBLE) AS hi,
    TRY_CAST(replace(regexp_extract(x, '{_A}\\s*{_U}?', 1), ',', '') AS DOUBLE) AS v, regexp_extract(x, '{_A}\\s*{_U}?', 2) AS vu,
    regexp_extract_all(x, '{_U}')[-1] AS last_unit FROM (SELECT p_partkey, lower({_REVENUE}) AS x FROM part)))"""
)
def norm_inr_revenue(t: Tables) -> DataFrame:
    made = values.inr_revenue(F.expr(_REVENUE))
    return t.table("part").select("p_partkey", *(made[n].alias(n) for n in ("value_inr", "range_min_inr", "range_max_inr")))


_DAY = "CASE o_orderkey % 4 WHEN 0 THEN {iso} WHEN 1 THEN concat({d}, '-', {m}, '-', {y}) WHEN 2 THEN concat({d}, '/', {m}, '/', {y}) ELSE 'soon' END"
_PARTS = {k: f"CAST({k2}(o_orderdate) AS VARCHAR(9))" for k, k2 in (("d", "day"), ("m", "month"), ("y", "year"))}
_DAY = _DAY.format(iso="concat({y}, '-', {m}, '-', {d})".format(**_PARTS), **_PARTS)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed FROM orders")
def norm_flexible_date(t: Tables) -> DataFrame:
    return t.table("orders").select("o_orderkey", values.flexible_date(F.expr(_DAY)).cast("string").alias("parsed"))


@query(
    "SELECT company_id, CASE WHEN company_id % 3 <> 0 THEN CAST(company_id AS VARCHAR) || '.mail.example.com' END AS domain, "
    "CASE WHEN annual_revenue_inr IS NULL THEN 'Unknown' WHEN annual_revenue_inr >= 10000000 THEN 'Cr' WHEN annual_revenue_inr >= 100000 THEN 'L' ELSE 'INR' END AS unit, "
    "CASE WHEN employee_count IS NOT NULL THEN CAST(employee_count AS VARCHAR) WHEN employee_range_max IS NOT NULL THEN CAST(employee_range_min AS VARCHAR) || '–' || "
    "CAST(employee_range_max AS VARCHAR) WHEN employee_range_min IS NOT NULL THEN CAST(employee_range_min AS VARCHAR) || '+' ELSE 'Unknown' END AS employees, "
    "CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM companies",
    "companies",
)
def presentation_formats(t: Tables) -> DataFrame:
    mail = F.when(F.col("company_id") % 3 != 0, F.concat(F.lit("x@"), F.col("company_id").cast("string"), F.lit(".Mail.example.COM"))).otherwise("none")
    shown = values.format_inr(F.col("annual_revenue_inr"))
    unit = F.when(shown == "Unknown", "Unknown").when(shown.endswith(" Cr"), "Cr").when(shown.endswith(" L"), "L").otherwise("INR")
    return t.view("companies").select(
        "company_id", text.email_domain(mail).alias("domain"), unit.alias("unit"),
        values.format_employees(F.col("employee_count"), F.col("employee_range_min"), F.col("employee_range_max")).alias("employees"),
        values.confidence_label(F.col("confidence")).alias("label"),
    )


@query(
    "SELECT job_id, regexp_replace(concat('GET /x?api-key=', CAST(job_id AS VARCHAR), '&y=1'), '(?i)((?:x-)?(?:api[-_]?key|token|secret))[''\"]?\\s*[:=]\\s*[''\"]?[^&\\s''\"]+', '\\1=***', 'g') AS shown, "
    "job_id % 4 = 1 AS safe FROM jobs",
    "jobs",
)
def str_redact_and_url_safety(t: Tables) -> DataFrame:
    url = F.expr("CASE job_id % 4 WHEN 0 THEN 'http://192.168.0.1/x' WHEN 1 THEN 'https://Example.com:8080/a' WHEN 2 THEN 'ftp://example.com' ELSE 'https://u:p@example.com' END")
    line = F.concat(F.lit("GET /x?api-key="), F.col("job_id").cast("string"), F.lit("&y=1"))
    return t.view("jobs").select("job_id", text.scrub_secrets(line).alias("shown"), text.safe_url(url).alias("safe"))


@query(
    "SELECT job_id, TRY_CAST(trunc(TRY_CAST(x AS DOUBLE)) AS INTEGER) AS whole, CASE WHEN lower(trim(x)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(x)) IN ('false', '0', 'no') THEN false END AS truth "
    "FROM (SELECT job_id, CASE job_id % 6 WHEN 0 THEN '12.7' WHEN 1 THEN ' Yes ' WHEN 2 THEN '0' WHEN 3 THEN 'x1' WHEN 4 THEN 'FALSE' ELSE '-3.9' END AS x FROM jobs)",
    "jobs",
)
def safe_casts(t: Tables) -> DataFrame:
    x = F.expr("CASE job_id % 6 WHEN 0 THEN '12.7' WHEN 1 THEN ' Yes ' WHEN 2 THEN '0' WHEN 3 THEN 'x1' WHEN 4 THEN 'FALSE' ELSE '-3.9' END")
    return t.view("jobs").select("job_id", values.safe_int(x).alias("whole"), values.safe_bool(x).alias("truth"))


@query(
    "SELECT page_id, regexp_matches(CASE WHEN page_id % 2 = 0 THEN concat('U12345mh2001PTC', lpad(CAST(page_id AS VARCHAR), 6, '0')) WHEN page_id % 3 = 0 THEN concat('12345U', lpad(CAST(page_id AS VARCHAR), 15, '0')) "
    "ELSE 'U12345MH2001PTC12345' END, '^[A-Za-z][0-9]{5}[A-Za-z]{2}[0-9]{4}[A-Za-z]{3}[0-9]{6}$') AS valid FROM pages"
)
def str_cin(t: Tables) -> DataFrame:
    cin = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("U12345mh2001PTC"), F.lpad(F.col("page_id").cast("string"), 6, "0")))
    cin = cin.when(F.col("page_id") % 3 == 0, F.concat(F.lit("12345U"), F.lpad(F.col("page_id").cast("string"), 15, "0"))).otherwise("U12345MH2001PTC12345")
    return t.table("pages").select("page_id", text.valid_cin(cin).alias("valid"))


# --- sources and observations ---------------------------------------------------------------------------------------


def _registry(t: Tables) -> DataFrame:
    """A registry's export under its own column names."""
    return t.view("companies").select(
        F.expr("CASE WHEN company_id % 13 = 0 THEN '  ' WHEN company_id % 17 = 0 THEN 'SHORT' ELSE concat('U12345MH2001PTC', lpad(CAST(company_id % 700 AS STRING), 6, '0')) END").alias("CIN"),
        F.col("canonical_name").alias("company_name "),
        F.lit("Active").alias("COMPANY_STATUS(for efiling)"),
        F.col("industry").alias("COMPANY_CLASS"),
        F.expr("CASE WHEN company_id % 19 <> 0 THEN date_format(incorporation_date, 'dd-MM-yyyy') END").alias("DATE_OF_INCORPORATION"),
        F.expr("CASE WHEN company_id % 5 <> 4 THEN concat(state, ' ') END").alias("REGISTERED_STATE"),
        F.expr("CASE WHEN company_id % 10 = 0 THEN 'N.A.' ELSE CAST(company_id AS STRING) END").alias("AUTHORIZED_CAP"),
        F.lit("?").alias("SOME_FUTURE_FIELD"),
        "company_id",
    )


_REGISTRY_SQL = """SELECT company_id, CASE WHEN company_id % 13 = 0 THEN '' WHEN company_id % 17 = 0 THEN 'SHORT' ELSE concat('U12345MH2001PTC', lpad(CAST(company_id % 700 AS VARCHAR), 6, '0')) END AS cin,
  canonical_name AS name, CASE WHEN company_id % 5 <> 4 THEN state ELSE '' END AS state, CASE WHEN company_id % 10 = 0 THEN 'N.A.' ELSE CAST(company_id AS VARCHAR) END AS capital, industry, CASE WHEN company_id % 19 <> 0 THEN incorporation_date END AS incorporation_date FROM companies"""


@query(f"WITH r AS ({_REGISTRY_SQL}) SELECT cin, name AS company_name, state AS registered_state, length(cin) = 21 AS valid FROM r WHERE cin <> ''", "companies")
def map_external_columns(t: Tables) -> DataFrame:
    """SRC-04/05, MAP-01, STR-11."""
    return adapters.registry_records(_registry(t).drop("company_id")).select("cin", "company_name", "registered_state", "valid")


@query(
    f"""WITH r AS ({_REGISTRY_SQL}), f AS (SELECT cin, unnest([
    {{'field': 'cin', 'value': cin}}, {{'field': 'country_code', 'value': 'IN'}}, {{'field': 'legal_name', 'value': name}}, {{'field': 'company_status', 'value': 'active'}},
    {{'field': 'canonical_name', 'value': trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g'))}},
    {{'field': 'company_type', 'value': lower(industry)}}, {{'field': 'incorporation_date', 'value': CAST(incorporation_date AS VARCHAR)}},
    {{'field': 'state', 'value': nullif(lower(state), '')}}, {{'field': 'authorized_capital_inr', 'value': CASE WHEN capital = 'N.A.' THEN NULL ELSE capital END}}]) AS x, state FROM r WHERE length(cin) = 21)
    SELECT x.field AS field, x.value AS value, count(*) AS n FROM f WHERE NOT (x.field = 'state' AND state = '') AND NOT (x.field = 'incorporation_date' AND x.value IS NULL) GROUP BY 1, 2""",
    "companies",
)
def obs_unpivot(t: Tables) -> DataFrame:
    """OBS-01, OBS-05: a value may be null, as of a malformed capital."""
    records = adapters.registry_records(_registry(t).drop("company_id")).filter("valid")
    return adapters.registry_observations(records).groupBy("field", "value").agg(F.count("*").alias("n"))


@query(
    "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, md5(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), "
    "'&amp;', '&')) AS heading, len(regexp_extract_all(html, '<li>')) AS items FROM pages"
)
def html_extract(t: Tables) -> DataFrame:
    """SRC-08, SRC-10: selectors over real pages."""
    found = adapters.extracted(t.table("pages").select("page_id", "html"), {"lang": "html::attr(lang)", "heading": "h1::text", "items": "nav li"})
    return found.select(
        "page_id", F.get("lang", F.lit(0)).alias("lang"), F.md5(F.array_join("heading", "").cast("binary")).alias("heading"), F.size("items").cast("bigint").alias("items")
    )


@query(
    "SELECT 'k' AS field, 'int' AS kinds, count(*) AS seen FROM jobs WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "jobs",
)
def schema_discovery(t: Tables) -> DataFrame:
    """SRC-18."""
    found = adapters.discovered_schema(t.view("jobs"), "props")
    return found.select("field", F.array_join("kinds", ",").alias("kinds"), "seen")


@query(
    "SELECT dataset, array_to_string(list_sort(list_filter(cols, lambda x: NOT list_contains(['CIN', 'ROC', 'STATE'], x))), ',') AS unknown, array_to_string(list_sort(list_filter(cols, lambda x: list_contains(['CIN', 'ROC', 'STATE'], x))), ',') AS matched, "
    "array_to_string(list_sort(list_filter(['CIN', 'ROC', 'STATE'], lambda x: NOT list_contains(cols, x))), ',') AS missing FROM (SELECT company_id AS dataset, [CASE WHEN company_id % 2 = 0 THEN 'CIN' ELSE 'OTHER' END, "
    "CASE WHEN company_id % 3 = 0 THEN 'ROC' ELSE 'FUTURE' END] AS cols FROM companies)",
    "companies",
)
def mapping_compare(t: Tables) -> DataFrame:
    """AGG-14, SET-02."""
    cols = F.expr("array(CASE WHEN company_id % 2 = 0 THEN 'cin (x)' ELSE 'Other' END, CASE WHEN company_id % 3 = 0 THEN ' roc ' ELSE 'future' END)")
    found = mapping.compared(t.view("companies").select(F.col("company_id").alias("dataset"), cols.alias("columns")), ["CIN", "ROC", "STATE"])
    return found.select("dataset", *(F.array_join(c, ",").alias(c) for c in ("unknown", "matched", "missing")))


@query(
    f"""WITH r AS ({_REGISTRY_SQL}) SELECT count(*) AS rows, count(*) FILTER (WHERE cin = '') AS missing_cin, count(*) FILTER (WHERE cin <> '' AND length(cin) <> 21) AS malformed_cin,
    count(*) FILTER (WHERE incorporation_date IS NULL) AS missing_date, count(*) FILTER (WHERE state = '') AS missing_state, count(*) FILTER (WHERE capital = 'N.A.') AS malformed_money,
    (SELECT count(*) - count(DISTINCT cin) FROM r WHERE cin <> '') AS duplicate_cin, (SELECT count(*) - count(DISTINCT lower(name)) FROM r) AS duplicate_name FROM r""",
    "companies",
)
def import_quality(t: Tables) -> DataFrame:
    rows = mapping.renamed(_registry(t)).select(
        "cin", F.col("company_name").alias("name"), F.col("date_of_registration").alias("registered"), F.col("registered_state").alias("state"), F.col("authorized_capital").alias("capital")
    )
    return health.import_quality(rows)


@query(
    f"WITH r AS ({_REGISTRY_SQL}) SELECT company_id, row_number() OVER (PARTITION BY cin ORDER BY company_id) AS occurrence FROM r WHERE cin <> '' QUALIFY occurrence > 1", "companies"
)
def duplicate_detection(t: Tables) -> DataFrame:
    """WIN-04."""
    rows = _registry(t).filter(F.trim("CIN") != "")
    return health.repeats_in_order(rows, "CIN", "company_id").select("company_id", F.col("occurrence").cast("bigint").alias("occurrence"))


@query("SELECT company_id, state FROM companies ORDER BY company_id LIMIT 40 OFFSET 25", "companies")
def row_window(t: Tables) -> DataFrame:
    """SRC-14."""
    return adapters.window(t.view("companies"), "company_id", 25, 40).select("company_id", "state")


@query("SELECT company_id, canonical_name FROM companies WHERE company_id = 17", "companies")
def point_lookup(t: Tables) -> DataFrame:
    return adapters.lookup(t.view("companies"), "company_id", 17).select("company_id", "canonical_name")


@query(
    "SELECT job_id, CASE WHEN s < 400 THEN 'ok' WHEN s IN (401, 403) THEN 'authentication' WHEN s = 404 THEN 'not_found' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'retry' ELSE 'rejected' END AS verdict "
    "FROM (SELECT job_id, [200, 401, 404, 429, 503, 418][CAST(job_id % 6 AS INTEGER) + 1] AS s FROM jobs)",
    "jobs",
)
def fetch_verdicts(t: Tables) -> DataFrame:
    status = F.expr("element_at(array(200, 401, 404, 429, 503, 418), CAST(job_id % 6 AS INT) + 1)")
    return t.view("jobs").select("job_id", adapters.fetch_verdict(status).alias("verdict"))


@query(
    "SELECT company_id, CASE WHEN company_id % 4 = 0 THEN 'patched' ELSE industry END AS industry FROM companies WHERE company_id % 10 <> 0 AND company_id % 9 <> 0 "
    "UNION ALL SELECT company_id, 'replaced' FROM companies WHERE company_id % 9 = 0",
    "companies",
)
def sink_rewrites(t: Tables) -> DataFrame:
    """SNK-02, SNK-08, SNK-09 as what they leave."""
    base = t.view("companies").select("company_id", "industry")
    kept = sinks.without(base, base.filter("company_id % 10 = 0"), "company_id")
    kept = sinks.patched(kept, base.filter("company_id % 4 = 0").withColumn("industry", F.lit("patched")), "company_id", ["industry"])
    return sinks.upserted(kept, base.filter("company_id % 9 = 0").withColumn("industry", F.lit("replaced")), ["company_id"])


@query(
    f"SELECT count(*) AS rows, count(*) FILTER (WHERE job_id % 7 <> 0) AS valid, count(*) FILTER (WHERE job_id % 7 = 0) AS invalid, count(*) FILTER (WHERE job_id % 6 IN (1, 3, 4)) AS skipped_cells FROM jobs",
    "jobs",
)
def custom_import_stats(t: Tables) -> DataFrame:
    """AGG-11."""
    rows = t.view("jobs").select(F.expr("CASE WHEN job_id % 7 = 0 THEN ' ' ELSE 'Name' END").alias("legal_name"), F.expr(_MONEY).alias("annual_revenue_inr"))
    return health.custom_import_stats(rows, mapping.CUSTOM_TYPES)


_HAS = {"canonical_name", "incorporation_date", "city", "state", "country", "country_code", "industry", "company_category", "export_status", "employee_count", "employee_range_min", "employee_range_max",
        "annual_revenue_inr", "revenue_range_min_inr", "revenue_range_max_inr", "confidence"}
_SHOWN_AS = {"id": "company_id", "last_verified_at": "epoch_us(last_verified_at)", "products": "CASE WHEN company_id % 2 = 0 THEN 'Pumps|Bolts' END", "incorporation_date": "CAST(incorporation_date AS VARCHAR)"}


@query("SELECT " + ", ".join(f"{_SHOWN_AS.get(c, c if c in _HAS else 'CAST(NULL AS VARCHAR)')} AS {c}" for c in projections.COMPANY) + " FROM companies", "companies")
def company_out(t: Tables) -> DataFrame:
    """PRJ-01: every column."""
    out = projections.company_out(t.view("companies").withColumn("products", F.expr("CASE WHEN company_id % 2 = 0 THEN array('Pumps', 'Bolts') END")))
    return out.withColumns({"last_verified_at": F.unix_micros("last_verified_at"), "incorporation_date": F.col("incorporation_date").cast("string"), **{c: F.array_join(c, "|") for c in ("products", "services")}})


# --- evidence -------------------------------------------------------------------------------------------------------

_SCORED = """scored AS (SELECT o.company_id, o.source_id, o.field, o.value, o.verification_type, o.collected_at, o.obs_id, lower(trim(coalesce(o.value, ''))) AS value_key,
  greatest(0, least(100, s.reliability_weight)) / 100.0 * CASE o.verification_type WHEN 'verified' THEN 1.0 WHEN 'observed' THEN 0.7 WHEN 'estimated' THEN 0.5 ELSE 0.1 END
  * exp(-greatest(0.0, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o.collected_at)) / 86400000000.0) / 365.0) AS score,
  CASE o.verification_type WHEN 'verified' THEN 1.0 WHEN 'observed' THEN 0.7 WHEN 'estimated' THEN 0.5 ELSE 0.0 END AS label_weight
  FROM observations o JOIN sources s ON o.source_id = s.source_id)"""
_ROLLED = f"""{_SCORED}, byv AS (SELECT company_id, field, value_key, count(*) AS agreeing, max(score) AS best, min((collected_at, obs_id)) AS first_seen, max(collected_at) AS newest,
  arg_min(value, (-label_weight, collected_at, obs_id)) AS value, arg_min(verification_type, (-label_weight, collected_at, obs_id)) AS verification_type FROM scored GROUP BY 1, 2, 3),
  ranked AS (SELECT *, sum(agreeing) OVER g AS total, max(newest) OVER g AS newest_all, row_number() OVER (PARTITION BY company_id, field ORDER BY agreeing DESC, best DESC, first_seen) AS rnk
  FROM byv WINDOW g AS (PARTITION BY company_id, field)),
  evidence AS (SELECT company_id, field, value, verification_type, agreeing, total, newest_all AS newest, best,
  greatest(0.0, least(1.0, best + least(0.15, 0.05 * (agreeing - 1)) - (1 - CAST(agreeing AS DOUBLE) / total) * 0.30)) AS raw FROM ranked WHERE rnk = 1)"""


def _scores(t: Tables) -> DataFrame:
    return evidence.scored(t.view("observations"), t.view("sources"), AS_OF)


@query(f"WITH {_SCORED} SELECT company_id, field, count(*) AS n, round(sum(score), 4) AS total_score FROM scored GROUP BY 1, 2", "observations", "sources")
def cnf_scores(t: Tables) -> DataFrame:
    return _scores(t).groupBy("company_id", "field").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total_score"))


@query(f"WITH {_ROLLED} SELECT company_id, field, value, verification_type, agreeing, CAST(total AS BIGINT) AS total FROM evidence", "observations", "sources")
def cnf_winner(t: Tables) -> DataFrame:
    return evidence.roll_up(_scores(t)).select("company_id", "field", "value", "verification_type", "agreeing", "total")


@query(f"WITH {_ROLLED} SELECT company_id, field, round(raw, 3) AS confidence FROM evidence", "observations", "sources")
def cnf_rollup(t: Tables) -> DataFrame:
    return evidence.roll_up(_scores(t)).select("company_id", "field", "confidence")


@query(
    f"""WITH {_ROLLED} SELECT e.company_id, CAST((2 * sum(CAST(round(raw * 1000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000 AS confidence, epoch_us(max(CASE WHEN verification_type = 'verified' THEN newest END)) AS last_verified_at,
    count(*) AS field_count, any_value(n.source_count) AS source_count FROM evidence e JOIN (SELECT company_id, count(DISTINCT source_id) AS source_count FROM scored GROUP BY 1) n
    ON e.company_id = n.company_id GROUP BY e.company_id""",
    "observations", "sources",
)
def cnf_company(t: Tables) -> DataFrame:
    scores = _scores(t)
    return evidence.company_confidence(evidence.roll_up(scores), scores).withColumn("last_verified_at", F.unix_micros("last_verified_at"))


_EACH = [f"f{i}" for i in range(1, 8)]


@query(f"WITH {_ROLLED} SELECT company_id, {', '.join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in _EACH)} FROM evidence GROUP BY 1", "observations", "sources")
def canonical_pivot(t: Tables) -> DataFrame:
    """SNK-04 over all fields that these observations have; ``canonical_companies`` has the typed ones."""
    return evidence.roll_up(_scores(t)).groupBy("company_id").pivot("field", _EACH).agg(F.first("value"))


@query("SELECT DISTINCT o.company_id, o.field, o.obs_id, o.source_id FROM observations o JOIN sources s ON o.source_id = s.source_id", "observations", "sources")
def evidence_lineage(t: Tables) -> DataFrame:
    return evidence.lineage(_scores(t)).distinct()


@query(
    f"WITH {_ROLLED} SELECT c.company_id, coalesce(e.fields, '') AS fields FROM companies c LEFT JOIN (SELECT company_id, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM evidence GROUP BY 1) e "
    "ON c.company_id = e.company_id",
    "observations", "sources", "companies",
)
def company_detail(t: Tables) -> DataFrame:
    """PRJ-04."""
    out = evidence.detail(t.view("companies"), evidence.roll_up(_scores(t)))
    return out.select("company_id", F.array_join(F.transform("evidence", lambda e: F.concat(e.field, F.lit("="), e.value)), ",").alias("fields"))


# --- resolution -------------------------------------------------------------------------------------------------------

_TRIGRAMS = """pieces AS (SELECT DISTINCT p_name AS name, piece FROM (SELECT p_name, unnest(list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substr('  ' || w || ' ', i, 3))) AS piece
  FROM (SELECT p_name, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM (SELECT DISTINCT p_name FROM part)) WHERE w <> '')),
  sizes AS (SELECT name, count(*) AS n FROM pieces GROUP BY 1),
  pairs AS (SELECT a.name AS left_name, b.name AS right_name, count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS similarity
  FROM pieces a JOIN pieces b ON a.piece = b.piece JOIN sizes x ON a.name = x.name JOIN sizes y ON b.name = y.name GROUP BY 1, 2)"""


@query(f"WITH {_TRIGRAMS} SELECT left_name, right_name, round(similarity, 4) AS similarity FROM pairs WHERE similarity > 0.3")
def er_trigram_pairs(t: Tables) -> DataFrame:
    names = t.table("part").select(F.col("p_name").alias("name"))
    return resolution.similar_pairs(names, names).select("left_name", "right_name", F.round("similarity", 4).alias("similarity"))


def _signals(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers as incoming records, customers as companies."""
    record = t.table("supplier").select(
        F.col("s_suppkey").alias("record_id"),
        F.expr("CASE WHEN s_suppkey % 4 = 0 THEN concat('cin', CAST(s_suppkey AS STRING)) END").alias("cin"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN concat(' g', CAST(s_suppkey AS STRING)) END").alias("gstin"),
        F.expr("concat('Host', CAST(s_suppkey % 60 AS STRING), '.example')").alias("domain"),
        F.col("s_name").alias("name"), F.expr("CAST(s_nationkey AS STRING)").alias("state"), F.lit("").alias("postal"), F.lit(None).cast("string").alias("email_domain"),
    )
    company = t.table("customer").select(
        F.col("c_custkey").alias("company_id"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('CIN', CAST(c_custkey AS STRING)) END").alias("cin"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('G', CAST(c_custkey AS STRING)) END").alias("gstin"),
        F.expr("CASE WHEN c_custkey % 10 = 0 THEN concat('host', CAST(c_custkey AS STRING), '.example') END").alias("domain"),
        F.col("c_name").alias("name"), F.expr("CAST(c_nationkey AS STRING)").alias("state"), F.lit("").alias("postal"), F.lit(None).cast("string").alias("email_domain"),
    )
    return resolution.folded(record, "record_id"), resolution.folded(company, "company_id")


_EXACT = """r AS (SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 4 = 0 THEN concat('CIN', CAST(s_suppkey AS VARCHAR)) END AS cin, CASE WHEN s_suppkey % 5 = 0 THEN concat('G', CAST(s_suppkey AS VARCHAR)) END AS gstin,
  concat('host', CAST(s_suppkey % 60 AS VARCHAR), '.example') AS domain FROM supplier),
  c AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 2 = 0 THEN concat('CIN', CAST(c_custkey AS VARCHAR)) END AS cin, CASE WHEN c_custkey % 3 = 0 THEN concat('G', CAST(c_custkey AS VARCHAR)) END AS gstin,
  CASE WHEN c_custkey % 10 = 0 THEN concat('host', CAST(c_custkey AS VARCHAR), '.example') END AS domain FROM customer),
  found AS (SELECT record_id, company_id, r.cin = c.cin AS by_cin, r.gstin = c.gstin AS by_gstin, r.domain = c.domain AS by_domain FROM r JOIN c ON r.cin = c.cin OR r.gstin = c.gstin OR r.domain = c.domain)"""


@query(f"WITH {_EXACT} SELECT record_id, company_id FROM found QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY company_id) <= 10")
def er_exact_candidates(t: Tables) -> DataFrame:
    records, companies = _signals(t)
    return resolution.exact_candidates(records, companies)


@query(
    f"WITH {_EXACT} SELECT record_id, company_id, CAST(CASE WHEN by_cin THEN 1.0 WHEN by_gstin THEN 0.95 ELSE 0.75 END AS DOUBLE) AS score, "
    "CASE WHEN by_cin OR by_gstin THEN 'auto_match' ELSE 'review' END AS decision FROM found"
)
def er_score_rules(t: Tables) -> DataFrame:
    records, companies = _signals(t)
    named = lambda df: df.withColumn("name", F.lit(None).cast("string"))
    pairs = resolution.exact_candidates(records, companies, cap=None)
    return resolution.scored(pairs, named(records), named(companies)).select("record_id", "company_id", "score", "decision")


@query(
    "SELECT job_id AS candidate_id, company_id, company_name FROM (SELECT job_id, source_id FROM jobs WHERE job_id % 3 = 0) q LEFT JOIN (SELECT company_id, canonical_name AS company_name FROM companies "
    "WHERE company_id % 2 = 0) c ON q.source_id = c.company_id",
    "jobs", "companies",
)
def review_queue_detail(t: Tables) -> DataFrame:
    """ER-12, JN-08."""
    queue = t.view("jobs").select(F.col("job_id").alias("candidate_id"), F.col("source_id").alias("company_id"), F.expr("CASE WHEN job_id % 3 = 0 THEN 'pending' ELSE 'rejected' END").alias("status"))
    out = health.queue_detail(queue, t.view("companies").filter("company_id % 2 = 0"))
    return out.select("candidate_id", F.when(F.col("company_name").isNotNull(), F.col("company_id")).alias("company_id"), "company_name")


@query(
    "SELECT candidate_id, CASE WHEN candidate_id % 5 = 0 AND candidate_id % 2 = 0 THEN 'confirmed' WHEN candidate_id % 5 = 1 THEN 'rejected' WHEN candidate_id % 2 = 0 THEN 'pending' ELSE 'auto' END AS status "
    "FROM (SELECT job_id AS candidate_id FROM jobs)",
    "jobs",
)
def review_decisions(t: Tables) -> DataFrame:
    """ER-10, ER-11."""
    queue = t.view("jobs").select(F.col("job_id").alias("candidate_id"), F.expr("CASE WHEN job_id % 2 = 0 THEN 'pending' ELSE 'auto' END").alias("status"))
    verdicts = t.view("jobs").filter("job_id % 5 < 2").select(F.col("job_id").alias("candidate_id"), F.expr("CASE WHEN job_id % 5 = 0 THEN 'confirm' ELSE 'reject' END").alias("verdict"))
    return resolution.review(queue, verdicts).select("candidate_id", "status")


# --- reports ----------------------------------------------------------------------------------------------------------


@query(
    """SELECT source_id, count(*) AS total_jobs, CAST(sum(records_updated) AS BIGINT) AS records_total, arg_max(status, (created_at, job_id)) AS last_status,
    epoch_us(max(created_at)) AS last_run_at, epoch_us(max(CASE WHEN status = 'success' THEN finished_at END)) AS last_success_at,
    arg_max(error_summary, (created_at, job_id)) FILTER (WHERE status = 'failed') AS last_error FROM jobs GROUP BY source_id""",
    "jobs",
)
def source_health(t: Tables) -> DataFrame:
    return health.source_health(t.view("jobs")).withColumns({c: F.unix_micros(c) for c in ("last_run_at", "last_success_at")})


_SHOWN = "coalesce(nullif(s.display_name, ''), s.name)"


@query(
    f"SELECT company_id, string_agg(shown, '|' ORDER BY shown) AS sources FROM (SELECT DISTINCT o.company_id, o.source_id, {_SHOWN} AS shown FROM observations o JOIN sources s ON o.source_id = s.source_id) GROUP BY 1",
    "observations", "sources",
)
def source_names_by_company(t: Tables) -> DataFrame:
    out = health.source_names(t.view("observations"), t.view("sources"), ["company_id"])
    return out.select("company_id", F.array_join("sources", "|").alias("sources"))


@query(
    f"SELECT company_id, field, string_agg(shown, '|' ORDER BY shown) AS sources FROM (SELECT DISTINCT o.company_id, o.field, o.source_id, {_SHOWN} AS shown FROM observations o JOIN sources s "
    "ON o.source_id = s.source_id) GROUP BY 1, 2",
    "observations", "sources",
)
def source_names_by_evidence(t: Tables) -> DataFrame:
    out = health.source_names(t.view("observations"), t.view("sources"), ["company_id", "field"])
    return out.select("company_id", "field", F.array_join("sources", "|").alias("sources"))


@query(
    f"SELECT s.source_id, {_SHOWN} AS shown, coalesce(j.n, 0) AS total_jobs FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM jobs GROUP BY 1) j ON s.source_id = j.source_id", "sources", "jobs"
)
def source_list(t: Tables) -> DataFrame:
    """JN-11, PRJ-06/07."""
    return health.health_of_all(t.view("sources"), t.view("jobs")).select("source_id", "shown", "total_jobs")


@query("SELECT job_id, epoch_us(created_at) AS created_at FROM jobs WHERE status = 'failed' ORDER BY jobs.created_at DESC, job_id LIMIT 50", "jobs")
def job_list(t: Tables) -> DataFrame:
    return health.job_list(t.view("jobs"), "failed").select("job_id", F.unix_micros("created_at").alias("created_at"))


@query(
    "SELECT source_id, count(*) AS discovered, count(*) FILTER (WHERE status <> 'failed') AS updated, count(*) FILTER (WHERE status = 'failed') AS failed, "
    "CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'success' ELSE 'partial' END AS status FROM jobs GROUP BY source_id",
    "jobs",
)
def job_rollup(t: Tables) -> DataFrame:
    return health.job_roll_up(t.view("jobs").withColumn("ok", F.col("status") != "failed"), ["source_id"])


@query(
    "SELECT source_id, idempotency_key, CASE WHEN enabled THEN 'queued' ELSE 'failed' END AS status FROM (SELECT DISTINCT s.source_id, s.enabled, concat('k', CAST(j.k AS VARCHAR)) AS idempotency_key, s.source_type "
    "FROM sources s CROSS JOIN (SELECT unnest(range(20)) AS k) j) r WHERE source_type <> 'uploaded' AND NOT EXISTS (SELECT 1 FROM jobs x WHERE x.status = 'success' AND x.source_id = r.source_id AND x.idempotency_key = r.idempotency_key)",
    "sources", "jobs",
)
def idempotent_dispatch(t: Tables) -> DataFrame:
    keys = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("k"), k.cast("string")))).alias("idempotency_key")
    requests = t.view("sources").select("source_id", "enabled", "source_type", keys)
    return health.idempotent(requests, t.view("jobs")).select("source_id", "idempotency_key", "status")


@query(
    "SELECT CAST(floor(confidence * 5) AS INTEGER) AS bucket, CAST(CAST(floor(confidence * 5) AS INTEGER) * 20 AS VARCHAR) || '-' || CAST(CAST(floor(confidence * 5) AS INTEGER) * 20 + 20 AS VARCHAR) || '%' AS label, "
    "count(*) AS companies FROM companies WHERE confidence IS NOT NULL GROUP BY 1, 2",
    "companies",
)
def confidence_histogram(t: Tables) -> DataFrame:
    return health.confidence_histogram(t.view("companies"))


@query("SELECT DISTINCT country_code AS country FROM companies", "companies")
def country_list(t: Tables) -> DataFrame:
    return health.countries(t.view("companies").select(F.array("country_code").alias("countries")))


@query(
    "SELECT o_custkey AS company_id, financial_year, turnover FROM (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS financial_year, round(sum(o_totalprice), 2) AS turnover FROM orders GROUP BY 1, 2) "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY financial_year DESC) = 1"
)
def financial_latest_year(t: Tables) -> DataFrame:
    years = t.table("orders").groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("string").alias("financial_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("turnover"))
    return health.newest_financials(years)


_BROKEN = "SELECT '{rule}' AS rule, (SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {key} HAVING count(*) > 1)) AS broken"


@query(
    " UNION ALL ".join(
        _BROKEN.format(rule=r, table=t, key=k)
        for r, t, k in (
            ("company cin", "(SELECT company_id % 1000 AS cin FROM companies)", "cin"), ("evidence company, field", "observations", "company_id, field"),
            ("financials company, year", "(SELECT o_custkey, year(o_orderdate) AS y FROM orders)", "o_custkey, y"), ("job source, key", "jobs", "source_id, idempotency_key"),
        )
    ),
    "companies", "observations", "jobs",
)
def quality_rules(t: Tables) -> DataFrame:
    """Tables that break each rule."""
    companies = t.view("companies").select("company_id", F.concat(F.lit("c"), (F.col("company_id") % 1000).cast("string")).alias("cin"))
    years = t.table("orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("financial_year"))
    return health.broken_rules(companies, t.view("observations").select("company_id", "field"), years, t.view("jobs"))


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["search_strength"](spark, folder)


def queries() -> dict[str, Query]:
    from factloom.plans import catalogue_checks, catalogue_more, catalogue_store, catalogue_streams  # noqa: F401  register their own

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from factloom.plans import catalogue_checks, catalogue_more, catalogue_store, catalogue_streams  # noqa: F401  register their own

    return ORACLES
