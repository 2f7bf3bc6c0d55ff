import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import filter_tree as tree
from factloom.operators import search, validation
from factloom.sources import mapping


def _plainly(text):
    """What the tree's own constructors and its compilation say."""
    try:
        node = tree.loads(text)
        leaves = [node]
        while leaves:
            x = leaves.pop()
            if isinstance(x, tree.Group):
                leaves += x.conditions[::-1]
            else:
                tree.spec_of(x, tree.FIELDS)
    except (tree.InvalidFilterConditionError, tree.UnknownFilterFieldError) as e:
        return type(e).__name__
    except (KeyError, ValueError, TypeError, AttributeError):
        return "InvalidFilterConditionError"
    return "accepted"


def _random_tree(pick, depth):
    if depth and pick.random() < 0.6:
        return {"op": pick.choice(["AND", "OR", "NOT", "XOR"] if pick.random() < 0.1 else ["AND", "OR"]), "conditions": [_random_tree(pick, depth - 1) for _ in range(pick.choice([1, 2, 2, 3]))]}
    if pick.random() < 0.8:
        return {"field": "state", "operator": "=", "data_type": "string", "value": "x"}
    kind = pick.choice([*tree.OPERATORS, "colour"])
    value = pick.choice([None, 1, "a", True, [], [1], [1, 2], ["a", "b", "c"]])
    return {"field": pick.choice([*tree.FIELDS, "colour"]), "operator": pick.choice([o for own in tree.OPERATORS.values() for o in own]), "data_type": kind, "value": value}


def test_random_trees_are_judged_as_by_their_constructors(spark):
    pick = random.Random(8)
    texts = [json.dumps(_random_tree(pick, 4)) for _ in range(250)]
    texts += [None, "", "no json", "[]", "3", "{}", '{"op": "AND"}', '{"conditions": []}', '{"field": "state", "operator": "EXISTS", "data_type": "string"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, filter_json string").repartition(3)
    got = {r.id: r.outcome for r in validation.judged_searches(rows, "id").collect()}
    assert got == {i: _plainly(t) if t is not None else "InvalidFilterConditionError" for i, t in enumerate(texts)}
    assert {"accepted", "UnknownFilterFieldError", "InvalidFilterConditionError"} == set(got.values())


def test_the_first_fault_is_named(spark):
    ok = {"field": "state", "operator": "=", "data_type": "string", "value": "x"}
    other = {**ok, "field": "colour"}
    wrong = {**ok, "value": None}
    trees = [other, {"op": "AND", "conditions": [ok, {"op": "NOT", "conditions": [other]}, other]}, {"op": "OR", "conditions": [other, ok, {"op": "AND", "conditions": [ok, wrong]}]}, ok]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id long, filter_json string")
    got = sorted(tuple(r) for r in validation.judged_searches(rows, "id").collect())
    unknown, invalid = "UnknownFilterFieldError", "InvalidFilterConditionError"
    assert got == [(0, unknown, ""), (1, unknown, "1.0"), (2, invalid, "2.1"), (3, "accepted", None)]


def test_empty_table(spark):
    assert validation.judged_searches(spark.createDataFrame([], "id long, filter_json string"), "id").count() == 0


def test_flat_queries_as_by_their_constructor(spark):
    rows = [(0, -1, None, 1, 0), (1, 3, 0.5, 200, 0), (2, None, 1.5, 5, 0), (3, None, None, 201, 0), (4, None, None, 0, 0), (5, None, 0.0, 1, -1), (6, None, None, None, None)]
    got = {r.id: r.outcome for r in validation.judged_flat(spark.createDataFrame(rows, "id long, employee_min long, min_confidence double, limit long, offset long")).collect()}
    for i, employees, confidence, limit, offset in rows:
        try:
            search.FlatFilters(employee_min=employees, min_confidence=confidence, **({} if limit is None else {"limit": limit, "offset": offset}))
            assert got[i] == "accepted"
        except tree.InvalidFilterConditionError:
            assert got[i] == "InvalidFilterConditionError"


def test_mappings_as_by_their_check(spark):
    maps = [{}, {"a": "legal_name"}, {"a": "legal_name", "b": "colour"}, {"a": "legal_name", "b": "legal_name"}, {"a": "cin"}, {"a": "cin", "b": "legal_name"}, {"a": "cin", "b": "cin", "c": "colour"}]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(maps)] + [(99, None)], "id long, mapping map<string,string>")
    got = {r.id: (r.outcome, r.reason) for r in validation.judged_mappings(rows).collect()}
    assert got.pop(99) == ("MappingError", "empty")
    for i, m in enumerate(maps):
        try:
            mapping.validate(m)
            assert got[i] == ("accepted", None)
        except mapping.MappingError:
            assert got[i][0] == "MappingError"


def test_saved_searches_keep_unknown_rows_apart_and_select_fields(spark):
    companies = spark.createDataFrame([(1, "IN", "goa", 0.5), (2, "IN", None, 0.1), (3, "US", None, 0.9), (4, "IN", "delhi", 0.7)], "company_id long, country_code string, state string, confidence double")
    saved = {"filter_json": tree.dumps(tree.Condition("state", "=", "string", "goa")), "country_scope": ["IN"], "handling": search.UNKNOWN_SEPARATELY, "selected_fields": ["company_id", "match_strength"]}
    out = search.run_saved(companies, saved)
    assert out.columns == ["company_id", "match_strength", "bucket"] and sorted(tuple(r) for r in out.collect()) == [(1, "definite", "results"), (2, "unknown", "unknown")]
    assert search.run_saved(companies, {**saved, "handling": search.DEFINITE_ONLY}).columns == ["company_id", "match_strength"]
    for bad in ({**saved, "handling": "other"}, {**saved, "selected_fields": ["colour"]}):
        with pytest.raises((tree.InvalidFilterConditionError, tree.UnknownFilterFieldError)):
            search.run_saved(companies, bad)
    pages = search.run_saved(companies.withColumn("extra", F.lit(1)), {**saved, "limit": 1, "selected_fields": None})
    assert pages.count() == 2 and "extra" in pages.columns
