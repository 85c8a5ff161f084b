"""Read-only gate, join safety and budgets for SQL from users."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Rejected(ValueError):
    """A statement that may not run."""


class Exhausted(RuntimeError):
    """A result beyond its budget; nothing of it is returned."""


#: Plan nodes of a parsed query; a statement with any other node is no query.
_QUERY_NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith CTERelationRef CTERelationDef WithCTE "
    "UnresolvedHaving UnresolvedInlineTable LocalRelation ResolvedInlineTable OneRowRelation Generate Window WithWindowDefinition UnresolvedSubqueryColumnAliases LateralJoin Pivot Unpivot UnresolvedTVFAliases "
    "UnresolvedTableValuedFunction Range Sample View UnresolvedHint ResolvedHint UnresolvedTableSpec AsOfJoin Expand GroupingSets".split()
)
#: Functions that call into the machine, read files or tell where they are.
_BARRED_FUNCTIONS = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true current_user user session_user current_catalog "
    "current_database current_schema version spark_partition_id monotonically_increasing_id ai_query http_request".split()
)
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer collations sequence".split())
_DESCRIBES = ("Explain", "Describe")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(node, allowed: frozenset[str] | None, inside: frozenset[str]) -> None:
    """Check a parsed plan, the plans in its expressions and its named parts; ``inside`` are names that WITH gives."""
    name = _name(node)
    if name not in _QUERY_NODES:
        raise Rejected(f"{name} is not part of a query")
    if name == "UnresolvedWith":
        for entry in _items(node.cteRelations()):
            _walk(entry._2(), allowed, inside)
            inside = inside | {entry._1().lower()}
    if name == "UnresolvedRelation":
        parts = [p.lower() for p in _items(node.multipartIdentifier())]
        if len(parts) > 2 or (len(parts) == 2 and parts[0] != "information_schema" and (allowed is None or ".".join(parts) not in allowed)):
            raise Rejected(f"{'.'.join(parts)} is no relation here")
        if len(parts) == 1 and allowed is not None and parts[0] not in allowed | inside:
            raise Rejected(f"{parts[0]} is no relation here")
    if name == "UnresolvedTableValuedFunction" and [p.lower() for p in _items(node.name())][-1] not in _TABLE_FUNCTIONS:
        raise Rejected("a table function that may not be used")
    for e in _items(node.expressions()):
        _expression(e, allowed, inside)
    for child in _items(node.children()):
        _walk(child, allowed, inside)


def _expression(e, allowed: frozenset[str] | None, inside: frozenset[str]) -> None:
    name = _name(e)
    if name == "UnresolvedFunction" and [p.lower() for p in _items(e.nameParts())][-1] in _BARRED_FUNCTIONS:
        raise Rejected(f"{'.'.join(_items(e.nameParts()))} may not be called")
    if name in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression") and hasattr(e, "plan"):
        try:
            plan = e.plan()
        except Exception:  # an IN holds its query as a child
            plan = None
        if plan is not None:
            _walk(plan, allowed, inside)
    for child in _items(e.children()):
        _expression(child, allowed, inside)


def read_only(spark: SparkSession, sql: str, relations: Iterable[str] | None = None) -> None:
    """One statement, and it is a query, EXPLAIN or DESCRIBE that reads named relations only.

    The parsed plan is walked with all queries inside it: nodes that are not a query's, files named as relations, relations other
    than ``relations`` (if given), and functions that reach into the machine are rejected.
    """
    allowed = None if relations is None else frozenset(r.lower() for r in relations)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"not one readable statement: {str(e).splitlines()[0]}") from e
    name = _name(plan)
    if name.startswith("Explain"):
        return _walk(plan.logicalPlan(), allowed, frozenset())
    if name in ("DescribeQueryCommand",):
        return _walk(plan.plan(), allowed, frozenset())
    if name.startswith("Describe") and name in ("DescribeRelation", "DescribeTableCommand", "DescribeColumn"):
        parts = [p.lower() for p in _items(plan.children().apply(0).multipartIdentifier())]
        if len(parts) != 1 or (allowed is not None and parts[0] not in allowed):
            raise Rejected(f"{'.'.join(parts)} is no relation here")
        return None
    return _walk(plan, allowed, frozenset())


def evidence(sql: str) -> bool:
    """Textual check: one statement that starts like a query."""
    text = sql.strip().rstrip(";").strip()
    return ";" not in text and bool(re.match(r"(?i)(explain\s+)?(select|with)\b", text))


def _conjuncts(e) -> list:
    return [x for c in _items(e.children()) for x in _conjuncts(c)] if _name(e) == "And" else [e]


def _plans(node) -> Iterable:
    """The plans of the queries inside a node's expressions."""
    stack = _items(node.expressions())
    while stack:
        e = stack.pop()
        if _name(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            yield e.plan()
        stack += _items(e.children())


def join_safe(df: DataFrame, datasets: dict[str, set[str]]) -> None:
    """Joins of two sides from one many-source Dataset must equate ``_file_``.

    ``datasets`` maps a Dataset to the names of its views. The analysed plan is walked from the bottom: which columns are some Dataset's ``_file_``
    is followed through aliases, and a join is safe if one of the conditions that all must hold equates two of them, one from each side.
    """
    views = {v: name for name, found in datasets.items() for v in found}

    def walk(node) -> tuple[set[str], dict[int, str]]:
        name = _name(node)
        if name == "SubqueryAlias" and (own := node.identifier().name().split(".")[-1]) in views:
            return {views[own]}, {a.exprId().id(): views[own] for a in _items(node.output()) if a.name().lower() == "_file_"}
        sides = [walk(c) for c in _items(node.children())]
        files = {k: v for _, f in sides for k, v in f.items()}
        for plan in _plans(node):
            walk(plan)
        if name in ("Project", "Aggregate"):
            listed = node.projectList() if name == "Project" else node.aggregateExpressions()
            for e in _items(listed):
                if _name(e) == "Alias" and _name(e.child()) == "AttributeReference" and e.child().exprId().id() in files:
                    files[e.exprId().id()] = files[e.child().exprId().id()]
        if name == "Union":  # its columns are those of its first side, if all sides have a Dataset's files there
            for place, a in enumerate(_items(node.output())):
                found = {f.get(_items(c.output())[place].exprId().id()) for c, (_, f) in zip(_items(node.children()), sides, strict=True)}
                if len(found) == 1 and None not in found:
                    files[a.exprId().id()] = found.pop()
        if name in ("Join", "LateralJoin") and len(sides) == 2 and (both := sides[0][0] & sides[1][0]):
            held = _conjuncts(node.condition().get()) if node.condition().isDefined() else []
            met = set()
            for e in held:
                if _name(e) in ("EqualTo", "EqualNullSafe"):
                    a, b = (files.get(c.exprId().id()) if _name(c) == "AttributeReference" else None for c in _items(e.children()))
                    one = [c.exprId().id() if _name(c) == "AttributeReference" else None for c in _items(e.children())]
                    if a is not None and a == b and {*(k in sides[0][1] for k in one)} == {True, False}:
                        met.add(a)
            if both - met:
                raise Rejected(f"a join within {', '.join(sorted(both - met))} must equate _file_")
        return set().union(*(s for s, _ in sides)), files

    walk(df._jdf.queryExecution().analyzed())


def rows_within(df: DataFrame, max_rows: int) -> list[dict]:
    """All rows, if there are at most ``max_rows``."""
    rows = [r.asDict(recursive=True) for r in df.limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise Exhausted(f"more than {max_rows} rows")
    return rows


#: Bytes of an evidence result, at least and at most.
LEAST_BYTES, MOST_BYTES = 1 << 10, 1 << 20


def clamp_bytes(wanted: int | None) -> int:
    return min(max(MOST_BYTES if wanted is None else wanted, LEAST_BYTES), MOST_BYTES)


def wrap(spark: SparkSession, sql: str, rows: int = 50) -> tuple[DataFrame, int]:
    """An evidence query cut to one more than the wanted rows (1 to 200); EXPLAIN as it is."""
    if not evidence(sql):
        raise Rejected("not a query")
    rows = min(max(rows, 1), 200)
    df = spark.sql(sql.strip().rstrip(";"))
    return (df if re.match(r"(?i)\s*explain\b", sql) else df.limit(rows + 1)), rows


def _columns(rows: Iterable[dict]) -> list[str]:
    return list(dict.fromkeys(k for r in rows for k in r))


def encode(rows: list[dict], form: str, max_bytes: int) -> bytes:
    """Rows as jsonl, csv or an aligned table; columns stand in order of first appearance."""
    if form == "jsonl":
        out = "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in rows)
    elif form == "csv":
        sink = io.StringIO()
        writer = csv.DictWriter(sink, _columns(rows), lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
        out = sink.getvalue()
    elif form == "table":
        names = _columns(rows)
        cells = [names, *([str(r.get(c, "") if r.get(c) is not None else "") for c in names] for r in rows)]
        widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
        out = "".join("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() + "\n" for line in cells)
    else:
        raise ValueError(f"unknown form {form!r}")
    data = out.encode()
    if len(data) > max_bytes:
        raise Exhausted(f"more than {max_bytes} bytes")
    return data
