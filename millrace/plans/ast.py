"""The query as data, and its JSON form on the wire."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from millrace.errors import Invalid

#: The comparison operators of the wire format.
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "IS", "IS NOT", "LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE", "IN", "NOT IN")
ALIASES = {"==": "=", "<>": "!="}


def operator(op: str) -> str:
    """The operator's wire name."""
    name = ALIASES.get(op, op.upper())
    if name not in OPERATORS:
        raise Invalid(f"unknown operator {op!r}")
    return name


def number(value: Any) -> Any:
    """A literal as the wire carries it: whole floats as integers, non-finite ones as null."""
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        if value.is_integer() and -(2**63) <= value < 2**63:
            return int(value)
    if isinstance(value, (list, tuple)):
        return [number(v) for v in value]
    return value


@dataclass(frozen=True)
class Column:
    name: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Simple:
    op: str
    left: Column | Literal
    right: Column | Literal


@dataclass(frozen=True)
class Group:
    """``kind`` is ``and`` or ``or``."""

    kind: str
    conditions: tuple[Condition, ...]


@dataclass(frozen=True)
class Gate:
    """(NOT) EXISTS of a correlated query."""

    related: Related
    negated: bool = False
    flip: bool | None = None
    scalar: bool | None = None


Condition = Simple | Group | Gate


@dataclass(frozen=True)
class Related:
    """A correlated query: its fields equal the parent's."""

    parent: tuple[str, ...]
    child: tuple[str, ...]
    query: Query
    system: str | None = None


@dataclass(frozen=True)
class Start:
    row: tuple[tuple[str, Any], ...]
    exclusive: bool = False


@dataclass(frozen=True)
class Aggregate:
    """``count``, or ``sum`` or ``avg`` of a column."""

    kind: str
    column: str | None = None


@dataclass(frozen=True)
class Query:
    table: str
    alias: str | None = None
    select: tuple[str, ...] | None = None
    where: Condition | None = None
    related: tuple[Related, ...] = ()
    start: Start | None = None
    limit: int | None = None
    one: bool = False
    aggregate: Aggregate | None = None
    precomputed: bool = False
    group_by: tuple[str, ...] = ()
    having: Condition | None = None
    order_by: tuple[tuple[str, str], ...] = ()
    schema: str | None = field(default=None, compare=False)

    def with_(self, **changes: Any) -> Query:
        """A copy with other parts."""
        return replace(self, **changes)


def gates(condition: Condition | None) -> Iterator[Gate]:
    """All gates of a condition, not those within them."""
    if isinstance(condition, Gate):
        yield condition
    elif isinstance(condition, Group):
        for c in condition.conditions:
            yield from gates(c)


# --- JSON -------------------------------------------------------------------------


def _value(v: Column | Literal) -> dict:
    return {"type": "column", "name": v.name} if isinstance(v, Column) else {"type": "literal", "value": number(v.value)}


def _condition(c: Condition) -> dict:
    if isinstance(c, Simple):
        return {"type": "simple", "op": c.op, "left": _value(c.left), "right": _value(c.right)}
    if isinstance(c, Group):
        return {"type": c.kind, "conditions": [_condition(x) for x in c.conditions]}
    out = {"type": "correlatedSubquery", "op": "NOT EXISTS" if c.negated else "EXISTS", "related": _related(c.related)}
    return out | {k: v for k, v in (("flip", c.flip), ("scalar", c.scalar)) if v is not None}


def _related(r: Related) -> dict:
    out = {"correlation": {"parentField": list(r.parent), "childField": list(r.child)}, "subquery": to_dict(r.query)}
    return out | ({"system": r.system} if r.system else {})


def to_dict(q: Query) -> dict:
    """The wire form; parts that are absent are left out."""
    out: dict[str, Any] = {"table": q.table}
    if q.schema is not None:
        out["schema"] = q.schema
    if q.alias is not None:
        out["alias"] = q.alias
    if q.select is not None:
        out["select"] = list(q.select)
    if q.where is not None:
        out["where"] = _condition(q.where)
    if q.related:
        out["related"] = [_related(r) for r in q.related]
    if q.start is not None:
        out["start"] = {"row": {k: number(v) for k, v in q.start.row}, "exclusive": q.start.exclusive}
    if q.limit is not None:
        out["limit"] = q.limit
    if q.one:
        out["one"] = True
    if q.aggregate is not None:
        out["aggregate"] = "count" if q.aggregate.kind == "count" else {q.aggregate.kind: q.aggregate.column}
    if q.precomputed:
        out["aggregatePrecomputed"] = True
    if q.group_by:
        out["groupBy"] = list(q.group_by)
    if q.having is not None:
        out["having"] = _condition(q.having)
    if q.order_by:
        out["orderBy"] = [list(o) for o in q.order_by]
    return out


def _value_of(d: dict) -> Column | Literal:
    return Column(d["name"]) if d["type"] == "column" else Literal(number(d["value"]))


def _condition_of(d: dict) -> Condition:
    kind = d["type"]
    if kind == "simple":
        return Simple(operator(d["op"]), _value_of(d["left"]), _value_of(d["right"]))
    if kind in ("and", "or"):
        return Group(kind, tuple(_condition_of(x) for x in d["conditions"]))
    if kind == "correlatedSubquery":
        return Gate(_related_of(d["related"]), d["op"] == "NOT EXISTS", d.get("flip"), d.get("scalar"))
    raise Invalid(f"unknown condition {kind!r}")


def _related_of(d: dict) -> Related:
    c = d["correlation"]
    return Related(tuple(c["parentField"]), tuple(c["childField"]), from_dict(d["subquery"]), d.get("system"))


def from_dict(d: dict) -> Query:
    """A query of its wire form."""
    a = d.get("aggregate")
    aggregate = None if a is None else Aggregate("count") if a == "count" else Aggregate(*next(iter(a.items())))
    start = d.get("start")
    return Query(
        table=d["table"],
        alias=d.get("alias"),
        select=tuple(d["select"]) if d.get("select") is not None else None,
        where=_condition_of(d["where"]) if d.get("where") else None,
        related=tuple(_related_of(r) for r in d.get("related", ())),
        start=Start(tuple((k, number(v)) for k, v in start["row"].items()), bool(start.get("exclusive", False))) if start else None,
        limit=d.get("limit"),
        one=bool(d.get("one", False)),
        aggregate=aggregate,
        precomputed=bool(d.get("aggregatePrecomputed", False)),
        group_by=tuple(d.get("groupBy", ())),
        having=_condition_of(d["having"]) if d.get("having") else None,
        order_by=tuple((c, way) for c, way in d.get("orderBy", ())),
        schema=d.get("schema"),
    )


def to_json(q: Query) -> str:
    """The wire text."""
    return json.dumps(to_dict(q), ensure_ascii=False)


def from_json(text: str) -> Query:
    """A query of its wire text."""
    return from_dict(json.loads(text))
