import random
from datetime import date

import duckdb
import pytest

from factloom.operators import filter_tree as T
from factloom.operators import search
from factloom.plans import filter_sql
from factloom.plans.bridge import Tables, duckdb as oracle
from factloom.plans.catalogue import C, G

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "company_id long, state string, city string, country_code string, industry string, company_category string, export_status boolean, confidence double, "
    "employee_count int, employee_range_min int, employee_range_max int, annual_revenue_inr double, revenue_range_min_inr double, revenue_range_max_inr double, "
    "incorporation_date date, last_verified_at timestamp, products array<string>"
)


def row(i, **more):
    base = {"state": "Delhi", "city": None, "country_code": "IN", "industry": "Steel", "company_category": "trader", "export_status": None, "confidence": 0.5,
            "employee_count": None, "employee_range_min": None, "employee_range_max": None, "annual_revenue_inr": None, "revenue_range_min_inr": None,
            "revenue_range_max_inr": None, "incorporation_date": date(2000, 1, 1), "last_verified_at": None, "products": []}
    base.update(more)
    return (i, *base.values())


@pytest.fixture(scope="module")
def ranges(spark):
    spans = [(30, 100), (10, 30), (1, 10), (None, None), (1000, None)]
    rows = [row(i, employee_range_min=a, employee_range_max=b) for i, (a, b) in enumerate(spans)] + [row(9, employee_count=25)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, node):
    out = search.advanced(df, node, limit=None).select("company_id", "match_strength").collect()
    return {r.company_id: r.match_strength for r in out}


def test_ranges_are_definite_possible_or_out(ranges):
    assert found(ranges, C("employees", ">=", 20)) == {0: "definite", 1: "possible", 9: "definite"}
    assert found(ranges, C("employees", "<", 20)) == {1: "possible", 2: "definite"}
    assert found(ranges, C("employees", "<=", 1000)) == {0: "definite", 1: "definite", 2: "definite", 4: "possible", 9: "definite"}
    assert found(ranges, C("employees", "BETWEEN", [10, 40])) == {0: "possible", 1: "definite", 2: "possible", 9: "definite"}
    assert found(ranges, C("employees", "IN", [10, 25])) == {1: "possible", 2: "possible", 9: "definite"}
    assert found(ranges, C("employees", "NOT_IN", [25, 200])) == {0: "definite", 2: "definite", 4: "definite"}
    assert found(ranges, C("employees", "EXISTS")) == {0: "definite", 1: "definite", 2: "definite", 4: "definite", 9: "definite"}


def test_handling_modes(ranges):
    node = C("employees", ">=", 20)
    assert [r.company_id for r in search.advanced(ranges, node, handling=search.DEFINITE_ONLY).collect()] == [0, 9]
    assert {r.company_id for r in search.unknown_bucket(ranges, node).collect()} == {3}
    assert search.unknown_bucket(ranges, G("OR", node, node)).count() == 0


def test_nulls_and_guards(spark):
    df = spark.createDataFrame([row(1, city="Pune"), row(2), row(3, city="Delhi")], SCHEMA)
    assert found(df, C("city", "!=", "pune")) == {3: "definite"}
    assert found(df, G("NOT", C("city", "!=", "PUNE"))) == {1: "definite", 2: "unknown"}
    assert found(df, G("NOT", C("city", "=", "PUNE"))) == {3: "definite"}
    assert found(df, C("city", "NOT_EXISTS")) == {2: "definite"}
    assert found(df, C("city", "CONTAINS", "u_e")) == {}


def test_validation():
    for bad in (lambda: C("employees", "CONTAINS", "x"), lambda: C("state", "IN", []), lambda: C("state", "=", None), lambda: C("state", "EXISTS", 1),
                lambda: C("employees", "BETWEEN", [1]), lambda: G("NOT", C("state", "EXISTS"), C("city", "EXISTS")), lambda: G("AND"), lambda: G("XOR", C("state", "EXISTS"))):
        with pytest.raises(T.InvalidFilterConditionError):
            bad()
    with pytest.raises(T.UnknownFilterFieldError):
        T.compile_tree(T.Condition("nothing", "=", "string", "x"))
    for bad in (T.Condition("state", "=", "number", 1), T.Condition("last_verified_at", "=", "date", "2000-01-01"), T.Condition("confidence", "IN", "number", [1]),
                T.Condition("export_status", "=", "boolean", "false"), T.Condition("employees", "=", "number", "3")):
        with pytest.raises(T.InvalidFilterConditionError):
            T.compile_tree(bad)


def test_json_and_form_rows():
    node = G("AND", C("state", "IN", ["a", "b"]), G("NOT", C("employees", ">", 3)))
    assert T.loads(T.dumps(node)) == node
    rows = [{"field": "state", "operator": "IN", "data_type": "string", "value": "a, b,,"}, {"field": "employees", "operator": ">", "data_type": "number", "value": "3"}]
    assert T.from_rows(rows) == G("AND", C("state", "IN", ["a", "b"]), C("employees", ">", 3.0))
    assert T.from_rows(rows[:1]) == C("state", "IN", ["a", "b"])


def test_plans_push_filters_down(spark):
    node = G("AND", C("state", "=", "FRANCE"), C("employees", ">=", 5))
    companies = spark.createDataFrame([row(1)], SCHEMA)
    path = spark.conf.get("spark.checkpoint.dir") + "/companies"
    companies.write.mode("overwrite").parquet(path)
    found_ = search.advanced(spark.read.parquet(path), G("AND", C("country_code", "=", "IN"), C("confidence", ">=", 0.3)), limit=5).select("company_id")
    plan = found_._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(confidence" in plan and "Python" not in plan
    assert T.always_definite(C("state", "=", "x")) and not T.always_definite(node)


def _random_tree(pick, depth):
    if depth and pick.random() < 0.7:
        op = pick.choice(["AND", "OR", "NOT"])
        return G(op, *(_random_tree(pick, depth - 1) for _ in range(1 if op == "NOT" else pick.randint(1, 3))))
    number = lambda: pick.choice([5, 8, 10, 12])
    return pick.choice([
        lambda: C("employees", pick.choice(["=", "!=", ">", ">=", "<", "<="]), number()), lambda: C("employees", "BETWEEN", sorted([number(), number()])),
        lambda: C("employees", pick.choice(["IN", "NOT_IN"]), [number(), number()]), lambda: C("revenue_inr", pick.choice([">", "<="]), pick.choice([1e6, 2e6, 3e6])),
        lambda: C("city", pick.choice(["=", "!=", "STARTS_WITH"]), pick.choice(["france", "CHINA", "i"])), lambda: C("company_category", pick.choice(["=", "!="]), "trader"),
        lambda: C("employees", pick.choice(["EXISTS", "NOT_EXISTS"])), lambda: C("export_status", "!=", True), lambda: C("incorporation_date", "<", "1995-05-01"),
    ])()


def test_random_trees_match_the_other_engine(spark):
    con, pick = duckdb.connect(), random.Random(3)
    for t in ("customer", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TABLE companies AS {oracle('SELECT * FROM companies', 'companies')}")
    companies = Tables(spark, SF).view("companies").cache()
    for _ in range(25):
        node = _random_tree(pick, 3)
        want = con.execute(f"SELECT company_id, {filter_sql.strength(node)} FROM companies WHERE {filter_sql.include(node)} ORDER BY 1").fetchall()
        got = sorted(tuple(r) for r in T.annotate(companies, node).select("company_id", "strength").collect())
        assert got == want, T.dumps(node)
        if "NOT" not in T.dumps(node):
            assert all(s >= 2 for _, s in got)


def test_flat_search(spark):
    rows = [row(1, industry="Steel pipes", products=["Big Pipes"], employee_range_min=10, employee_range_max=50, confidence=0.9), row(2, industry="Tea", employee_count=60)]
    df = spark.createDataFrame(rows, SCHEMA)
    evidence = spark.createDataFrame([(2, "verified")], "company_id long, verification_type string")
    ids = lambda **f: [(r.company_id, r.match_is_definite) for r in search.flat(df, search.FlatFilters(**f), evidence).collect()]
    assert ids(industry="s%p") == [(1, None)] and ids(product="pipe") == [(1, None)]
    assert ids(employee_min=20) == [(1, False), (2, True)] and ids(employee_max=49) == [(1, False)]
    assert ids(verification_type="verified") == [(2, None)]
    for bad in ({"limit": 0}, {"limit": 201}, {"employee_min": -1}, {"min_confidence": 1.5}):
        with pytest.raises(T.InvalidFilterConditionError):
            search.FlatFilters(**bad)


def test_sort_puts_unknown_last(spark):
    df = spark.createDataFrame([row(1, confidence=None), row(2, confidence=0.1), row(3, confidence=0.9), row(4, confidence=0.9)], SCHEMA)
    for direction, want in (("asc", [2, 3, 4, 1]), ("desc", [3, 4, 2, 1])):
        assert [r.company_id for r in df.orderBy(*T.compile_sort([("confidence", direction)], "company_id")).collect()] == want
    with pytest.raises(T.UnknownFilterFieldError):
        T.compile_sort([("x", "asc")], "company_id")
