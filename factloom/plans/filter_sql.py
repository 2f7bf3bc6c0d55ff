"""Filter trees as the other engine's SQL, for the oracle: written from the tables of meaning, not from the compiler."""

from __future__ import annotations

from factloom.operators.filter_tree import FIELDS, Condition, Group, Node

MIRROR = {"=": "=", "!=": "<>"}


def quoted(kind: str, value: object) -> str:
    if kind == "date":
        return f"DATE '{value}'"
    if kind == "boolean":
        return "true" if value else "false"
    if kind == "number":
        return f"CAST({value!r} AS DOUBLE)"
    return "'" + str(value).replace("'", "''") + "'"


def include(node: Node) -> str:
    if isinstance(node, Group):
        parts = [f"({include(x)})" for x in node.conditions]
        return f"NOT {parts[0]}" if node.op == "NOT" else f" {node.op} ".join(parts)
    spec, op, v = FIELDS[node.field], node.operator, node.value
    c = spec.column
    if op in ("EXISTS", "NOT_EXISTS"):
        there = f"({c} IS NOT NULL OR {spec.low} IS NOT NULL)" if spec.low else f"{c} IS NOT NULL"
        return there if op == "EXISTS" else f"NOT {there}"
    if node.kind == "number":
        lo, hi = (f"coalesce({c}, {spec.low})", f"coalesce({c}, {spec.high})") if spec.low else (c, c)
        each = lambda o, x: {"=": f"({lo} <= {x} AND {hi} >= {x})", "!=": f"NOT ({lo} <= {x} AND {hi} >= {x})", ">": f"{hi} > {x}",
                             ">=": f"{hi} >= {x}", "<": f"{lo} < {x}", "<=": f"{lo} <= {x}"}[o]
        if op == "BETWEEN":
            return f"{hi} >= {quoted('number', v[0])} AND {lo} <= {quoted('number', v[1])}"
        if op in ("IN", "NOT_IN"):
            return (" OR " if op == "IN" else " AND ").join(each("=" if op == "IN" else "!=", quoted("number", x)) for x in v)
        return each(op, quoted("number", v))
    if node.kind in ("string", "enum"):
        fold = (lambda x: f"lower({x})") if node.kind == "string" else (lambda x: x)
        listed = ", ".join(fold(quoted("string", x)) for x in v) if isinstance(v, list | tuple) else fold(quoted("string", v))
        return {
            "=": f"{fold(c)} = {listed}", "!=": f"{c} IS NOT NULL AND {fold(c)} <> {listed}", "CONTAINS": f"contains({fold(c)}, {listed})",
            "STARTS_WITH": f"starts_with({fold(c)}, {listed})", "IN": f"{fold(c)} IN ({listed})", "NOT_IN": f"{c} IS NOT NULL AND {fold(c)} NOT IN ({listed})",
        }[op]
    if op == "BETWEEN":
        return f"{c} BETWEEN {quoted(node.kind, v[0])} AND {quoted(node.kind, v[1])}"
    test = f"{c} {MIRROR.get(op, op)} {quoted(node.kind, v)}"
    return f"{c} IS NOT NULL AND {test}" if op == "!=" else test


def strength(node: Node) -> str:
    if isinstance(node, Group):
        parts = [strength(x) for x in node.conditions]
        if node.op == "NOT":
            return f"(CASE {parts[0]} WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE {parts[0]} END)"
        return parts[0] if len(parts) == 1 else f"{'least' if node.op == 'AND' else 'greatest'}({', '.join(parts)})"
    spec, op, v = FIELDS[node.field], node.operator, node.value
    c = spec.column
    if op in ("EXISTS", "NOT_EXISTS"):
        return f"(CASE WHEN {include(node)} THEN 3 ELSE 0 END)"
    if not spec.low:
        return f"(CASE WHEN {c} IS NULL THEN 1 WHEN {include(node)} THEN 3 ELSE 0 END)"
    lo, hi = f"coalesce({c}, {spec.low})", f"coalesce({c}, {spec.high})"
    if op in ("IN", "NOT_IN"):
        single = [strength(Condition(node.field, "=" if op == "IN" else "!=", "number", x)) for x in v]
        return single[0] if len(single) == 1 else f"{'greatest' if op == 'IN' else 'least'}({', '.join(single)})"
    nothing = f"WHEN {lo} IS NULL AND {hi} IS NULL THEN 1"
    exact = f"WHEN {c} IS NOT NULL THEN CASE WHEN {include(node)} THEN 3 ELSE 0 END"
    if op == "!=":
        x = quoted("number", v)
        return f"(CASE {nothing} {exact} WHEN {lo} = {x} AND {hi} = {x} THEN 0 WHEN {lo} <= {x} AND {hi} >= {x} THEN 2 ELSE 3 END)"
    if op == "BETWEEN":
        sure = f"{lo} >= {quoted('number', v[0])} AND {hi} <= {quoted('number', v[1])}"
    else:
        x = quoted("number", v)
        sure = {"=": f"{lo} = {x} AND {hi} = {x}", ">": f"{lo} > {x}", ">=": f"{lo} >= {x}", "<": f"{hi} < {x}", "<=": f"{hi} <= {x}"}[op]
    return f"(CASE {nothing} {exact} WHEN {sure} THEN 3 WHEN {include(node)} THEN 2 ELSE 0 END)"
