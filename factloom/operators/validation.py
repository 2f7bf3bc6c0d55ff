"""Stored searches, flat queries and mappings judged as tables, before any of them runs (FLT-26..28, FLT-50, MAP-04).

A filter tree is JSON of any depth, held as VARIANT and walked a level at a time: a level's nodes are judged by expressions, and the
children of its groups are the next one's rows. So the work is that of all nodes, in as many steps as the deepest tree has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import filter_tree as tree
from factloom.operators.cut import cut, let_go
from factloom.operators.search import LARGEST_PAGE
from factloom.sources import mapping as maps

ACCEPTED, INVALID, UNKNOWN_FIELD, MAPPING = "accepted", tree.InvalidFilterConditionError.__name__, tree.UnknownFilterFieldError.__name__, maps.MappingError.__name__


def _one_of(x: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*names), F.lit(False))


def _text(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", "string")


def _badly_made(op: Column, children: Column) -> Column:
    """FLT-28: groups."""
    some = F.size(children)
    return ~_one_of(op, ("AND", "OR", "NOT")) | (some == 0) | ((op == "NOT") & (some != 1))


def _badly_asked(kind: Column, operator: Column, value: Column, items: Column) -> Column:
    """FLT-26: an operator that the type lacks, or a value that the operator doesn't take."""
    fits = F.lit(False)
    for name, operators in tree.OPERATORS.items():
        fits = fits | ((kind == name) & _one_of(operator, operators))
    nothing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
    listed = F.when(nothing, False).otherwise(F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False)))
    wrong = (
        F.when(_one_of(operator, tree.KNOWN), ~nothing)
        .when(_one_of(operator, tree.SETS), ~listed | (F.size(items) == 0))
        .when(operator == "BETWEEN", ~listed | (F.size(items) != 2))
        .otherwise(nothing | listed)
    )
    return ~F.coalesce(fits, F.lit(False)) | F.coalesce(wrong, F.lit(True))


def _misfits(field: Column, kind: Column, operator: Column) -> Column:
    """FLT-27: the error of a condition that its field doesn't take, or null."""
    known, fits = _one_of(field, tuple(tree.FIELDS)), F.lit(False)
    for (own, allowed) in sorted({(s.kind, s.allowed()) for s in tree.FIELDS.values()}):
        names = tuple(n for n, s in tree.FIELDS.items() if (s.kind, s.allowed()) == (own, allowed))
        fits = fits | (_one_of(field, names) & (kind == own) & _one_of(operator, allowed))
    return F.when(~known, UNKNOWN_FIELD).when(~fits, INVALID)


def judged_searches(searches: DataFrame, key: str, filter_json: str = "filter_json") -> DataFrame:
    """(key, outcome, place): what becomes of each stored filter, and the first node that decides it, as the places of children from the root.

    What is wrong by itself comes before what the fields don't take, and earlier nodes before later ones. Text that is no JSON, null
    included, and nodes that lack what they need are invalid."""
    level = cut(searches.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(filter_json)).alias("node")), "level")
    levels, faults = [level], None
    while True:
        children = F.try_variant_get("node", "$.conditions", "array<variant>")
        rows = level.withColumn("children", children)
        group = F.col("children").isNotNull()
        kind, operator, value = _text(F.col("node"), "data_type"), _text(F.col("node"), "operator"), F.try_variant_get("node", "$.value", "variant")
        made = F.when(group, _badly_made(_text(F.col("node"), "op"), F.col("children"))).otherwise(_badly_asked(kind, operator, value, F.try_variant_get("node", "$.value", "array<variant>")))
        fault = F.when(F.coalesce(made, F.lit(True)), F.struct(F.lit(0).alias("rank"), F.col("path"), F.lit(INVALID).alias("outcome")))
        misfit = F.when(~group, _misfits(_text(F.col("node"), "field"), kind, operator))
        fault = fault.when(misfit.isNotNull(), F.struct(F.lit(1).alias("rank"), F.col("path"), misfit.alias("outcome")))
        found = rows.select("key", fault.alias("fault")).filter("fault IS NOT NULL")
        faults = found if faults is None else faults.union(found)
        below = rows.filter(group).select("key", "path", F.posexplode("children").alias("place", "node"))
        level = cut(below.select("key", F.concat("path", F.array("place")).alias("path"), "node"), "level")
        if not level.limit(1).count():
            break
        levels.append(level)
    first = cut(faults.groupBy("key").agg(F.min("fault").alias("fault")), "faults")
    for table in [*levels, level]:
        let_go(table)
    out = searches.select(F.col(key).alias("key")).join(first, "key", "left")
    place = F.array_join(F.transform("fault.path", lambda p: p.cast("string")), ".")
    return out.select(F.col("key").alias(key), F.coalesce("fault.outcome", F.lit(ACCEPTED)).alias("outcome"), place.alias("place"))


def judged_flat(queries: DataFrame) -> DataFrame:
    """FLT-50: flat queries, with their ``outcome``; parameters that a table lacks are not given."""
    bad = F.lit(False)
    for name in ("employee_min", "employee_max", "revenue_min_inr", "revenue_max_inr", "offset"):
        if name in queries.columns:
            bad = bad | F.coalesce(F.col(name) < 0, F.lit(False))
    if "min_confidence" in queries.columns:
        bad = bad | F.coalesce(~F.col("min_confidence").between(0, 1), F.lit(False))
    if "limit" in queries.columns:
        bad = bad | F.coalesce(~F.col("limit").between(1, LARGEST_PAGE), F.lit(False))
    return queries.withColumn("outcome", F.when(bad, INVALID).otherwise(ACCEPTED))


def judged_mappings(mappings: DataFrame, column: str = "mapping") -> DataFrame:
    """MAP-04: mappings from a file's columns to fields, with their ``outcome`` and the reason for it."""
    fields = F.map_values(column)
    known = F.array(*(F.lit(f) for f in maps.CUSTOM_TYPES))
    reason = (
        F.when(F.col(column).isNull() | (F.size(fields) == 0), "empty")
        .when(F.exists(fields, lambda f: f.isNull()) | (F.size(F.array_except(fields, known)) > 0), "unknown field")
        .when(F.size(F.array_distinct(fields)) < F.size(fields), "mapped twice")
        .when(~F.array_contains(fields, "legal_name"), "no name")
    )
    return mappings.withColumns({"reason": reason, "outcome": F.when(reason.isNull(), ACCEPTED).otherwise(MAPPING)})
