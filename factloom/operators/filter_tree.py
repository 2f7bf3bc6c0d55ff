"""The query language: filter trees, their validation, and their compilation to Columns (FLT-01..28, SRT-01).

A tree compiles to two Columns over one scan: ``include``, an SQL three-valued predicate that Catalyst pushes down,
and ``strength``, a number on the lattice 0 no match < 1 unknown < 2 possible < 3 definite, on which AND is least,
OR is greatest and NOT is the mirror of 0 and 3. Both come from one definition of each leaf.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types, operators, and the fields that may be asked for.
ORDER = ("=", "!=", ">", ">=", "<", "<=")
SETS, KNOWN = ("IN", "NOT_IN"), ("EXISTS", "NOT_EXISTS")
OPERATORS = {
    "string": ("=", "!=", "CONTAINS", "STARTS_WITH", *SETS, *KNOWN),
    "number": (*ORDER, *SETS, "BETWEEN", *KNOWN),
    "date": (*ORDER, "BETWEEN", *KNOWN),
    "boolean": ("=", "!=", *KNOWN),
    "enum": ("=", "!=", *SETS, *KNOWN),
}
STRENGTHS = ("no_match", "unknown", "possible", "definite")


class InvalidFilterConditionError(ValueError):
    """A condition that its field or type doesn't allow."""


class UnknownFilterFieldError(ValueError):
    """A field that isn't registered."""


@dataclass(frozen=True)
class FieldSpec:
    kind: str
    column: str
    low: str | None = None
    high: str | None = None
    operators: tuple[str, ...] | None = None

    def allowed(self) -> tuple[str, ...]:
        return self.operators or OPERATORS[self.kind]


def _strings(*names: str) -> dict[str, FieldSpec]:
    return {n: FieldSpec("string", n) for n in names}


FIELDS: dict[str, FieldSpec] = {
    **_strings("country", "country_code", "state", "city", "postal_code", "industry", "sub_industry", "legal_name", "canonical_name"),
    "website": FieldSpec("string", "website_domain"),
    **_strings("cin", "gstin"),
    "company_category": FieldSpec("enum", "company_category"),
    **_strings("company_type"),
    "export_status": FieldSpec("boolean", "export_status"),
    "incorporation_date": FieldSpec("date", "incorporation_date"),
    "last_verified_at": FieldSpec("date", "last_verified_at", operators=(">", ">=", "<", "<=", *KNOWN)),
    "confidence": FieldSpec("number", "confidence", operators=ORDER),
    "employees": FieldSpec("number", "employee_count", "employee_range_min", "employee_range_max"),
    "revenue_inr": FieldSpec("number", "annual_revenue_inr", "revenue_range_min_inr", "revenue_range_max_inr"),
    "revenue_year": FieldSpec("number", "revenue_year"),
}


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    kind: str
    value: Any = None

    def __post_init__(self):
        if self.operator not in OPERATORS.get(self.kind, ()):
            raise InvalidFilterConditionError(f"{self.operator} is no operator of {self.kind}")
        listed = isinstance(self.value, list | tuple)
        if self.operator in KNOWN and self.value is not None:
            raise InvalidFilterConditionError(f"{self.operator} takes no value")
        if self.operator in SETS and not (listed and self.value):
            raise InvalidFilterConditionError(f"{self.operator} takes a list")
        if self.operator == "BETWEEN" and not (listed and len(self.value) == 2):
            raise InvalidFilterConditionError("BETWEEN takes two values")
        if self.operator not in (*KNOWN, *SETS, "BETWEEN") and (self.value is None or listed):
            raise InvalidFilterConditionError(f"{self.operator} takes one value")


@dataclass(frozen=True)
class Group:
    op: str
    conditions: list = field(default_factory=list)

    def __post_init__(self):
        if self.op not in ("AND", "OR", "NOT") or not self.conditions or (self.op == "NOT" and len(self.conditions) != 1):
            raise InvalidFilterConditionError(f"{self.op} can't have {len(self.conditions)} conditions")


Node = Condition | Group


def from_dict(node: dict) -> Node:
    """JSN-01: a tree as JSON has it."""
    if "conditions" in node:
        return Group(node["op"], [from_dict(x) for x in node["conditions"]])
    return Condition(node["field"], node["operator"], node["data_type"], node.get("value"))


def to_dict(node: Node) -> dict:
    if isinstance(node, Group):
        return {"op": node.op, "conditions": [to_dict(x) for x in node.conditions]}
    return {"field": node.field, "operator": node.operator, "data_type": node.kind, "value": node.value}


def loads(text: str) -> Node:
    return from_dict(json.loads(text))


def dumps(node: Node) -> str:
    return json.dumps(to_dict(node))


def from_rows(rows: list[dict]) -> Node:
    """FLT-51: what a form sends: lists as text with commas, numbers and truth values as text."""

    def value(row: dict) -> Any:
        text, kind = row.get("value"), row["data_type"]
        if row["operator"] in KNOWN:
            return None
        cast: Callable = {"number": float, "boolean": lambda x: x.strip().lower() == "true"}.get(kind, str)
        if row["operator"] in (*SETS, "BETWEEN"):
            return [cast(x.strip()) for x in str(text).split(",") if x.strip()]
        return cast(text) if isinstance(text, str) else text

    made = [Condition(r["field"], r["operator"], r["data_type"], value(r)) for r in rows]
    return made[0] if len(made) == 1 else Group("AND", made)


def spec_of(condition: Condition, fields: dict[str, FieldSpec]) -> FieldSpec:
    """FLT-27: the field's entry, if the condition fits it."""
    spec = fields.get(condition.field)
    if spec is None:
        raise UnknownFilterFieldError(condition.field)
    if spec.kind != condition.kind or condition.operator not in spec.allowed():
        raise InvalidFilterConditionError(f"{condition.field} doesn't take {condition.operator} of {condition.kind}")
    return spec


def _literal(kind: str, column: str, value: Any) -> Any:
    """R6: the value with its field's type, at plan time."""
    if kind == "date":
        day = date.fromisoformat(str(value)[:10])
        return F.lit(day).cast("timestamp") if column == "last_verified_at" else F.lit(day)
    if kind == "boolean":
        if not isinstance(value, bool):
            raise InvalidFilterConditionError("a truth value is needed")
        return F.lit(value)
    if kind == "number":
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise InvalidFilterConditionError("a number is needed")
        return F.lit(value)
    return F.lit(str(value))


COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
Pair = tuple[Column, Column]


def _crisp(test: Column, known: Column, guarded: bool = False) -> Pair:
    """A test on one value: 3 or 0, and 1 where the value is unknown. Guarded tests are false then, not null."""
    include = known & test if guarded else test
    return include, F.when(~known, 1).when(test, 3).otherwise(0)


def _text(condition: Condition, c: Column, fold: bool) -> Pair:
    cast = lambda v: F.lit(str(v).lower() if fold else str(v))
    x, op, v, known = (F.lower(c) if fold else c), condition.operator, condition.value, c.isNotNull()
    tests = {
        "=": lambda: x == cast(v),
        "!=": lambda: x != cast(v),
        "CONTAINS": lambda: x.contains(cast(v)),
        "STARTS_WITH": lambda: x.startswith(cast(v)),
        "IN": lambda: x.isin(*(cast(i) for i in v)),
        "NOT_IN": lambda: ~x.isin(*(cast(i) for i in v)),
    }
    return _crisp(tests[op](), known, op in ("!=", "NOT_IN"))


def _ordered(condition: Condition, c: Column, column: str) -> Pair:
    op, known = condition.operator, c.isNotNull()
    if op == "BETWEEN":
        low, high = (_literal(condition.kind, column, v) for v in condition.value)
        return _crisp(c.between(low, high), known)
    return _crisp(COMPARE[op](c, _literal(condition.kind, column, condition.value)), known, op == "!=")


def _number(op: str, value: Any, lo: Column, hi: Column, exact: Column) -> Pair:
    """FLT-11..19: lo..hi is where the value is; exact tells that it is known itself."""
    if op in SETS:
        each = [_number("=" if op == "IN" else "!=", v, lo, hi, exact) for v in value]
        join, meet = (operator.or_, F.greatest) if op == "IN" else (operator.and_, F.least)
        return functools.reduce(join, (i for i, _ in each)), _many(meet, [s for _, s in each])
    known = lo.isNotNull() | hi.isNotNull()
    sure: Column
    maybe: Column
    if op == "BETWEEN":
        a, b = (_literal("number", "", v) for v in value)
        maybe, sure = (hi >= a) & (lo <= b), (lo >= a) & (hi <= b)
    else:
        v = _literal("number", "", value)
        within, alone = (lo <= v) & (hi >= v), (lo == v) & (hi == v)
        maybe, sure = {
            "=": (within, alone),
            "!=": (~within, ~within),
            ">": (hi > v, lo > v),
            ">=": (hi >= v, lo >= v),
            "<": (lo < v, hi < v),
            "<=": (lo <= v, hi <= v),
        }[op]
        if op == "!=":
            return maybe, F.when(~known, 1).when(alone, 0).when(within, F.when(exact, 0).otherwise(2)).otherwise(3)
    return maybe, F.when(~known, 1).when(sure, 3).when(maybe, F.when(exact, 3).otherwise(2)).otherwise(0)


def _many(function: Callable, columns: list[Column]) -> Column:
    """R2: least and greatest want two Columns."""
    return columns[0] if len(columns) == 1 else function(*columns)


def _leaf(condition: Condition, fields: dict[str, FieldSpec]) -> Pair:
    spec = spec_of(condition, fields)
    c, op = F.col(spec.column), condition.operator
    if spec.low:
        low, high = F.col(spec.low), F.col(spec.high)
        if op in KNOWN:
            there = c.isNotNull() | low.isNotNull()
            test = there if op == "EXISTS" else ~there
            return test, F.when(test, 3).otherwise(0)
        return _number(op, condition.value, F.coalesce(c, low), F.coalesce(c, high), c.isNotNull())
    if op in KNOWN:
        test = c.isNotNull() if op == "EXISTS" else c.isNull()
        return test, F.when(test, 3).otherwise(0)
    if spec.kind == "string":
        return _text(condition, c, True)
    if spec.kind == "enum":
        return _text(condition, c, False)
    if spec.kind == "number":
        return _number(op, condition.value, c, c, c.isNotNull())
    return _ordered(condition, c, spec.column)


def compile_tree(node: Node, fields: dict[str, FieldSpec] = FIELDS) -> Pair:
    """(include, strength) of a tree."""
    if isinstance(node, Condition):
        return _leaf(node, fields)
    parts = [compile_tree(x, fields) for x in node.conditions]
    includes, codes = [i for i, _ in parts], [s for _, s in parts]
    if node.op == "NOT":
        return ~includes[0], F.when(codes[0] == 0, 3).when(codes[0] == 3, 0).otherwise(codes[0])
    if node.op == "AND":
        return functools.reduce(operator.and_, includes), _many(F.least, codes)
    return functools.reduce(operator.or_, includes), _many(F.greatest, codes)


def always_definite(node: Node, fields: dict[str, FieldSpec] = FIELDS) -> bool:
    """R1: no range among plain conditions under AND, so what is included is definite."""
    if isinstance(node, Condition):
        return spec_of(node, fields).low is None
    return node.op == "AND" and all(isinstance(x, Condition) and always_definite(x, fields) for x in node.conditions)


def strength_name(code: Column) -> Column:
    """FLT-25: what a returned row is called; 0 is shown as unknown."""
    return F.when(code == 3, "definite").when(code == 2, "possible").otherwise("unknown")


def is_unknown(spec: FieldSpec) -> Column:
    """Whether nothing is known of a field."""
    columns = [spec.column, *([spec.low, spec.high] if spec.low else [])]
    return functools.reduce(operator.and_, (F.col(c).isNull() for c in columns))


def compile_sort(sort: list[tuple[str, str]], tie: str, fields: dict[str, FieldSpec] = FIELDS) -> list[Column]:
    """SRT-01: fields with asc or desc, what is unknown last; ``tie`` makes the order total."""
    out = []
    for name, direction in sort:
        if name not in fields:
            raise UnknownFilterFieldError(name)
        spec = fields[name]
        c = F.coalesce(F.col(spec.column), F.col(spec.low)) if spec.low else F.col(spec.column)
        out.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
    return [*out, F.col(tie).asc()]


def annotate(companies: DataFrame, node: Node, fields: dict[str, FieldSpec] = FIELDS) -> DataFrame:
    """The rows that a tree includes, with the code of their strength."""
    include, code = compile_tree(node, fields)
    return companies.filter(include).withColumn("strength", F.lit(3) if always_definite(node, fields) else code)
