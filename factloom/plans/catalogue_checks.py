"""Registered queries that judge stored searches, flat queries and mappings, one for each customer, before they run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import filter_tree as tree, search, validation
from factloom.operators.cut import scratch
from factloom.plans import filter_sql
from factloom.plans.bridge import Tables
from factloom.plans.catalogue import C, G, query
from factloom.sources import adapters, numbered

_FIELDS = (*tree.FIELDS, "colour")
_KINDS = (*tree.OPERATORS, "colour")
_OPERATORS = tuple(dict.fromkeys(o for own in tree.OPERATORS.values() for o in own))
#: Values as JSON has them: none, one, two, three, an empty list.
_SHAPES = ("null", "{x}", "[{x}, {x}]", "[{x}, {x}, {x}]", "[]")


def _pick(number: str, names: tuple[str, ...]) -> str:
    """One of names by a number, in SQL of both engines."""
    return f"CASE ({number}) % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _parts(k: str, i: int) -> dict[str, str]:
    """Condition i of customer k: two of three ask for a field as its type allows, the others for anything."""
    seed = f"(CAST(floor({k} / 3) AS BIGINT) * 7919 + {i * 104729})"
    whole = f"({k} + {i}) % 3 > 0"
    fields = tuple(n for n, s in tree.FIELDS.items() if "=" in s.allowed())
    field = f"CASE WHEN {whole} THEN {_pick(seed, fields)} ELSE {_pick(seed, _FIELDS)} END"
    own = _pick(seed, tuple(tree.FIELDS[n].kind for n in fields))
    return {
        "field": field, "kind": f"CASE WHEN {whole} THEN {own} ELSE {_pick(f'CAST(floor({seed} / 17) AS BIGINT)', _KINDS)} END",
        "operator": f"CASE WHEN {whole} THEN '=' ELSE {_pick(f'CAST(floor({seed} / 5) AS BIGINT)', _OPERATORS)} END",
        "shape": f"CASE WHEN {whole} THEN 1 ELSE CAST(floor({seed} / 11) AS BIGINT) % {len(_SHAPES)} END",
    }


_ALLOWED = ", ".join(f"('{k}', '{o}')" for k, own in tree.OPERATORS.items() for o in own)
_TAKEN = ", ".join(f"('{n}', '{s.kind}', '{o}')" for n, s in tree.FIELDS.items() for o in s.allowed())
#: Where the conditions stand in each form of a tree: one, AND, NOT, a NOT of two, OR of NOT and AND, an empty group.
_PLACES = ({0: ""}, {0: "0", 1: "1"}, {0: "0"}, {0: "0", 1: "1"}, {0: "0.0", 1: "1.0", 2: "1.1"}, {})
_CONDITIONS = " UNION ALL ".join(
    f"SELECT c_custkey AS k, {i} AS i, {', '.join(f'{e} AS {n}' for n, e in _parts('c_custkey', i).items())} FROM customer" for i in range(3)
)
_USED = ", ".join(f"({form}, {i}, '{place}')" for form, places in enumerate(_PLACES) for i, place in places.items())


def _group(op: str, *conditions: str) -> str:
    return f'{{"op": "{op}", "conditions": [{", ".join(conditions)}]}}'


@query(
    f"""WITH asked AS ({_CONDITIONS}), allowed AS (SELECT * FROM (VALUES {_ALLOWED}) v(kind, operator)), taken AS (SELECT * FROM (VALUES {_TAKEN}) v(field, kind, operator)),
    used AS (SELECT * FROM (VALUES {_USED}) v(form, i, place)),
    judged AS (SELECT a.k, u.place, a.i, CASE WHEN NOT EXISTS (SELECT 1 FROM allowed x WHERE x.kind = a.kind AND x.operator = a.operator) OR CASE WHEN operator IN ('EXISTS', 'NOT_EXISTS') THEN shape <> 0
      WHEN operator IN ('IN', 'NOT_IN') THEN shape NOT IN (2, 3) WHEN operator = 'BETWEEN' THEN shape <> 2 ELSE shape <> 1 END THEN 0
      WHEN NOT EXISTS (SELECT 1 FROM taken x WHERE x.field = a.field) THEN 1 WHEN NOT EXISTS (SELECT 1 FROM taken x WHERE x.field = a.field AND x.kind = a.kind AND x.operator = a.operator) THEN 2 END AS fault
      FROM asked a JOIN used u ON u.i = a.i AND u.form = a.k % 6),
    faults AS (SELECT k, place, CASE fault WHEN 1 THEN 'UnknownFilterFieldError' ELSE 'InvalidFilterConditionError' END AS outcome, least(fault, 1) AS rank, i FROM judged WHERE fault IS NOT NULL
      UNION ALL SELECT c_custkey, '', 'InvalidFilterConditionError', 0, -1 FROM customer WHERE c_custkey % 6 IN (3, 5)),
    firsts AS (SELECT * FROM faults QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank, i) = 1)
    SELECT c_custkey AS search_id, coalesce(outcome, 'accepted') AS outcome, place FROM customer LEFT JOIN firsts ON k = c_custkey"""
)
def stored_search_outcomes(t: Tables) -> DataFrame:
    """FLT-26 to 28: a search of each customer's, its tree of one of six forms, judged as a table."""
    rows = t.table("customer").selectExpr("c_custkey AS k", *(f"{e} AS {n}{i}" for i in range(3) for n, e in _parts("c_custkey", i).items()))

    def condition(i: int) -> str:
        x = f"CASE kind{i} WHEN 'number' THEN CAST(k AS STRING) WHEN 'boolean' THEN 'true' ELSE '\"2001-01-01\"' END"
        value = f"replace(CASE shape{i} " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(_SHAPES)) + f" END, '{{x}}', {x})"
        return f"concat('{{\"field\": \"', field{i}, '\", \"operator\": \"', operator{i}, '\", \"data_type\": \"', kind{i}, '\", \"value\": ', {value}, '}}')"

    forms = ("#0", _group("AND", "#0", "#1"), _group("NOT", "#0"), _group("NOT", "#0", "#1"), _group("OR", _group("NOT", "#0"), _group("AND", "#1", "#2")), _group("AND"))
    made = "CASE k % 6 " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(forms)) + " END"
    for i in range(3):
        made = f"replace({made}, '#{i}', {condition(i)})"
    return validation.judged_searches(rows.selectExpr("k AS search_id", f"{made} AS filter_json"), "search_id")


@query(
    "SELECT c_custkey AS query_id, CASE WHEN c_acctbal < 0 OR c_custkey % 7 - 1 < 0 OR c_custkey % 13 > 10 OR c_custkey % 250 NOT BETWEEN 1 AND 200 THEN 'InvalidFilterConditionError' ELSE 'accepted' END AS outcome FROM customer"
)
def flat_query_outcomes(t: Tables) -> DataFrame:
    """FLT-50: each customer's flat query."""
    made = t.table("customer").selectExpr("c_custkey AS query_id", "c_acctbal AS revenue_min_inr", "c_custkey % 7 - 1 AS employee_min", "(c_custkey % 13) / 10 AS min_confidence", "c_custkey % 250 AS limit")
    return validation.judged_flat(made).select("query_id", "outcome")


_MAPPED = ("legal_name", "cin", "state", "colour", "website")


@query(
    f"""WITH m AS (SELECT c_custkey AS k, c_custkey % 5 AS n, {_pick('c_custkey', _MAPPED)} AS a, {_pick('c_custkey // 5', _MAPPED)} AS b FROM customer)
    SELECT k AS mapping_id, CASE WHEN n = 4 THEN 'empty' WHEN a = 'colour' OR (n > 0 AND b = 'colour') THEN 'unknown field' WHEN n > 0 AND a = b THEN 'mapped twice'
    WHEN a <> 'legal_name' AND (n = 0 OR b <> 'legal_name') THEN 'no name' END AS reason,
    CASE WHEN reason IS NULL THEN 'accepted' ELSE 'MappingError' END AS outcome FROM m"""
)
def mapping_outcomes(t: Tables) -> DataFrame:
    """MAP-04: mappings of none, one or two columns."""
    m = t.table("customer").selectExpr("c_custkey AS k", "c_custkey % 5 AS n", f"{_pick('c_custkey', _MAPPED)} AS a", f"{_pick('CAST(floor(c_custkey / 5) AS BIGINT)', _MAPPED)} AS b")
    made = m.selectExpr("k AS mapping_id", "CASE WHEN n = 4 THEN CAST(map() AS MAP<STRING, STRING>) WHEN n = 0 THEN map('x', a) ELSE map('x', a, 'y', b) END AS mapping")
    return validation.judged_mappings(made).select("mapping_id", "reason", "outcome")


_NAMED = "CASE {s} WHEN 3 THEN 'definite' WHEN 2 THEN 'possible' ELSE 'unknown' END"
_APART = G("AND", C("employees", ">=", 8), C("company_category", "=", "trader"))
_NO_COUNT = "employee_count IS NULL AND employee_range_min IS NULL AND employee_range_max IS NULL"


@query(
    f"""WITH scoped AS (SELECT * FROM companies WHERE country_code IN ('AM', 'AF', 'EU') AND company_id IN (SELECT company_id FROM observations WHERE source_id IN (2, 5, 8))),
    r AS (SELECT state, company_id, {_NAMED.format(s=filter_sql.strength(_APART))} AS match_strength, 'results' AS bucket FROM scoped WHERE {filter_sql.include(_APART)} ORDER BY state ASC NULLS LAST, company_id LIMIT 20 OFFSET 2),
    u AS (SELECT state, company_id, 'unknown' AS match_strength, 'unknown' AS bucket FROM scoped WHERE ({_NO_COUNT} OR coalesce(employee_count, employee_range_max) >= 8)
      AND (company_category IS NULL OR company_category = 'trader') AND (company_category IS NULL OR {_NO_COUNT}) ORDER BY state ASC NULLS LAST, company_id LIMIT 20 OFFSET 2)
    SELECT * FROM r UNION ALL SELECT * FROM u""",
    "companies", "observations",
)
def saved_search_unknown(t: Tables) -> DataFrame:
    """FLT-31, FLT-32, PRJ-05: a saved search that keeps unknown rows apart, with the fields it selects, within its scopes."""
    saved = {
        "filter_json": tree.dumps(_APART), "country_scope": ["AM", "AF", "EU"], "source_scope": [2, 5, 8], "sort": [["state", "asc"]], "offset": 2, "limit": 20,
        "handling": search.UNKNOWN_SEPARATELY, "selected_fields": ["state", "company_id", "match_strength"],
    }
    return search.run_saved(t.view("companies"), saved, t.view("observations"))



@query(
    """WITH n AS (SELECT c_custkey AS k, c_custkey % 8 AS g, row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY c_custkey) - 1 AS row FROM customer)
    SELECT k, g, row, CASE WHEN k % 5 = 0 THEN concat('C', CAST(k AS VARCHAR)) ELSE concat('row-', CAST(row AS VARCHAR)) END AS ref, CAST(NULL AS VARCHAR) AS line FROM n WHERE k % 17 <> 0
    UNION ALL SELECT k, g, row, NULL, concat('Customer ', CAST(k AS VARCHAR), ',,', CAST(k AS VARCHAR), ',one more') FROM n WHERE k % 17 = 0"""
)
def numbered_rows(t: Tables) -> DataFrame:
    """SRC-01, SRC-09, SNK-06: customers' files of text, with their rows' numbers as references where there is no other, and the lines that are none."""
    path, k = scratch(t.spark, "lines"), F.col("k")
    name, cin = F.concat(F.lit("Customer "), k.cast("string")), F.when(k % 5 == 0, F.concat(F.lit("C"), k.cast("string"))).otherwise("")
    line = F.concat_ws(",", name, F.when(k % 17 == 0, "").otherwise(cin), k.cast("string"), F.when(k % 17 == 0, "one more"))
    rows = t.table("customer").select(F.col("c_custkey").cast("long").alias("k")).select((k % 8).alias("g"), "k", line.alias("value"))
    heads = t.spark.range(8).select(F.col("id").alias("g"), F.lit(-1).cast("long").alias("k"), F.lit("Company Name,CIN Number,Key").alias("value"))
    rows.union(heads).repartition("g").sortWithinPartitions("g", "k").select("g", "value").write.partitionBy("g").text(path)
    found = numbered.read_numbered(t.spark, path)
    group = F.regexp_extract("file", r"/g=(\d+)/", 1).cast("long")
    records = adapters.custom_records(found.rows.withColumn("__g", group), {"Company Name": "legal_name", "CIN Number": "cin", "Key": "industry", "__g": "state"}, "row")
    key = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long")
    rest = found.rejects.select(key("line").alias("k"), group.alias("g"), "row", F.lit(None).cast("string").alias("ref"), "line")
    number = found.rows.select(F.col("Key").alias("industry"), "row")
    good = records.join(number, "industry").select(F.col("industry").cast("long").alias("k"), F.col("state").cast("long").alias("g"), "row", F.col("external_ref").alias("ref"), F.lit(None).cast("string").alias("line"))
    return good.union(rest)
