"""The fluent way to write a query.

>>> table("orders").where("o_orderstatus", "O").order_by("o_totalprice", "desc").limit(50).build()
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from millrace.errors import Invalid, UnknownRelationship
from millrace.plans.ast import Aggregate, Column, Condition, Gate, Group, Literal, Query, Related, Simple, Start, operator

#: Names that a registered table may not start with.
RESERVED = ("__agg_", "_millrace_")


# --- predicates -------------------------------------------------------------------


def compare(field: str, op: str, value: Any) -> Simple:
    """``field op value``."""
    return Simple(operator(op), Column(field), Literal(value))


def eq(field: str, value: Any) -> Simple:
    return compare(field, "=", value)


def ne(field: str, value: Any) -> Simple:
    return compare(field, "!=", value)


def gt(field: str, value: Any) -> Simple:
    return compare(field, ">", value)


def ge(field: str, value: Any) -> Simple:
    return compare(field, ">=", value)


def lt(field: str, value: Any) -> Simple:
    return compare(field, "<", value)


def le(field: str, value: Any) -> Simple:
    return compare(field, "<=", value)


def like(field: str, pattern: str) -> Simple:
    return compare(field, "LIKE", pattern)


def not_like(field: str, pattern: str) -> Simple:
    return compare(field, "NOT LIKE", pattern)


def ilike(field: str, pattern: str) -> Simple:
    return compare(field, "ILIKE", pattern)


def not_ilike(field: str, pattern: str) -> Simple:
    return compare(field, "NOT ILIKE", pattern)


def in_list(field: str, values: list) -> Simple:
    return compare(field, "IN", list(values))


def not_in_list(field: str, values: list) -> Simple:
    return compare(field, "NOT IN", list(values))


def is_(field: str, value: Any) -> Simple:
    return compare(field, "IS", value)


def is_not(field: str, value: Any) -> Simple:
    return compare(field, "IS NOT", value)


def is_null(field: str) -> Simple:
    return compare(field, "IS", None)


def is_not_null(field: str) -> Simple:
    return compare(field, "IS NOT", None)


def all_of(*conditions: Condition) -> Group:
    return Group("and", tuple(conditions))


def any_of(*conditions: Condition) -> Group:
    return Group("or", tuple(conditions))


def folded(a: Any, op: str, b: Any) -> Simple:
    """A comparison of two literals."""
    return Simple(operator(op), Literal(a), Literal(b))


# --- relationships ----------------------------------------------------------------


class Parent:
    """Stands for the parent row inside a child's builder: ``p.o_orderkey``."""

    def __getattr__(self, name: str) -> ParentField:
        return ParentField(name)

    def col(self, name: str) -> ParentField:
        return ParentField(name)


@dataclass(frozen=True)
class ParentField:
    name: str


@dataclass(frozen=True)
class Relationship:
    """A named correlation: ``rel("orders", "lineitem", {"o_orderkey": "l_orderkey"})``."""

    parent_table: str
    child_table: str
    on: tuple[tuple[str, str], ...]


def rel(parent_table: str, child_table: str, on: dict[str, str]) -> Relationship:
    """A correlation for :meth:`Builder.sub`, :func:`exists` and the aggregates to reuse."""
    return Relationship(parent_table, child_table, tuple(on.items()))


Child = Callable[[Parent], "Builder"]


def _child(source: Child | Relationship | Builder, build: Callable[[Builder], Builder] | None = None) -> Builder:
    if isinstance(source, Relationship):
        child = table(source.child_table)
        for parent, own in source.on:
            child = child.where(own, ParentField(parent))
    else:
        child = source if isinstance(source, Builder) else source(Parent())
    return build(child) if build else child


def exists(source: Child | Relationship, build: Callable | None = None, *, flip: bool | None = None, scalar: bool | None = None, sync: bool = True) -> Gate:
    """A gate that keeps parents with a matching child; without ``sync`` it is a permission gate."""
    return Gate(_child(source, build).correlated(None if sync else "permissions"), False, flip, scalar)


def not_exists(source: Child | Relationship, build: Callable | None = None, *, flip: bool | None = None, scalar: bool | None = None, sync: bool = True) -> Gate:
    """A gate that keeps parents without a matching child."""
    return Gate(_child(source, build).correlated(None if sync else "permissions"), True, flip, scalar)


@dataclass(frozen=True)
class Fragment:
    """A reusable selection: columns and relationships of one table."""

    query: Query


def fragment(source: Builder) -> Fragment:
    """A fragment; it may neither filter, order, page nor limit its rows."""
    q = source.build()
    if q.where or q.order_by or q.limit is not None or q.start or q.aggregate:
        raise Invalid("a fragment selects; it may not filter, order, page, limit or aggregate")
    return Fragment(q)


@dataclass(frozen=True)
class Builder:
    """An unfinished query; every method returns another one."""

    query: Query
    keys: tuple[tuple[str, str], ...] = ()  # (own field, parent field)

    def _with(self, **changes: Any) -> Builder:
        return Builder(self.query.with_(**changes), self.keys)

    def select(self, *columns: str) -> Builder:
        return self._with(select=(*(self.query.select or ()), *columns))

    def where(self, field: str | Condition, value: Any = ...) -> Builder:
        """``where("a", 1)``, ``where(condition)``, or in a child ``where("k", parent.k)``."""
        if isinstance(value, ParentField):
            return Builder(self.query, (*self.keys, (field, value.name)))
        condition = field if value is ... else compare(field, "=", value)
        if isinstance(condition, str):
            raise Invalid("where() takes a condition, or a field and a value")
        old = self.query.where
        if old is None:
            return self._with(where=condition)
        parts = old.conditions if isinstance(old, Group) and old.kind == "and" else (old,)
        return self._with(where=Group("and", (*parts, condition)))

    def where_op(self, field: str, op: str, value: Any) -> Builder:
        return self.where(compare(field, op, value))

    def where_in(self, field: str, values: list) -> Builder:
        return self.where(in_list(field, values))

    def where_any(self, *conditions: Condition) -> Builder:
        return self.where(any_of(*conditions))

    def where_all(self, *conditions: Condition) -> Builder:
        return self.where(all_of(*conditions))

    def where_exists(self, source: Child | Relationship, build: Callable | None = None, **options: Any) -> Builder:
        return self.where(exists(source, build, **options))

    def where_not_exists(self, source: Child | Relationship, build: Callable | None = None, **options: Any) -> Builder:
        return self.where(not_exists(source, build, **options))

    def where_exists_no_sync(self, source: Child | Relationship, build: Callable | None = None) -> Builder:
        return self.where(exists(source, build, sync=False))

    def where_not_exists_no_sync(self, source: Child | Relationship, build: Callable | None = None) -> Builder:
        return self.where(not_exists(source, build, sync=False))

    def sub(self, alias: str, source: Child | Relationship, build: Callable | None = None) -> Builder:
        """Child rows, nested under ``alias``."""
        child = _child(source, build)._with(alias=alias)
        return self._with(related=(*self.query.related, child.correlated()))

    def _aggregate_as(self, alias: str, aggregate: Aggregate, source: Child | Relationship, build: Callable | None, precomputed: bool) -> Builder:
        child = _child(source, build)._with(alias=alias, aggregate=aggregate, precomputed=precomputed)
        return self._with(related=(*self.query.related, child.correlated()))

    def count_as(self, alias: str, source: Child | Relationship, build: Callable | None = None, *, precomputed: bool = False) -> Builder:
        return self._aggregate_as(alias, Aggregate("count"), source, build, precomputed)

    def sum_as(self, alias: str, column: str, source: Child | Relationship, build: Callable | None = None, *, precomputed: bool = False) -> Builder:
        return self._aggregate_as(alias, Aggregate("sum", column), source, build, precomputed)

    def avg_as(self, alias: str, column: str, source: Child | Relationship, build: Callable | None = None, *, precomputed: bool = False) -> Builder:
        return self._aggregate_as(alias, Aggregate("avg", column), source, build, precomputed)

    def having_count(self, alias: str, op: str, n: int) -> Builder:
        """Keep parents by the number of children that ``count_as(alias)`` counts."""
        for r in self.query.related:
            if r.query.alias == alias and r.query.aggregate == Aggregate("count"):
                hidden = r.query.with_(alias=f"__having_{alias}", having=compare("count", op, n))
                return self.where(Gate(Related(r.parent, r.child, hidden, r.system)))
        raise UnknownRelationship(f"having_count({alias!r}) needs count_as({alias!r})")

    def count(self) -> Builder:
        return self._with(aggregate=Aggregate("count"))

    def sum(self, column: str) -> Builder:
        return self._with(aggregate=Aggregate("sum", column))

    def avg(self, column: str) -> Builder:
        return self._with(aggregate=Aggregate("avg", column))

    def group_by(self, *columns: str) -> Builder:
        return self._with(group_by=(*self.query.group_by, *columns))

    def having(self, condition: Condition) -> Builder:
        return self._with(having=condition)

    def order_by(self, column: str, way: str = "asc") -> Builder:
        return self._with(order_by=(*self.query.order_by, (column, way)))

    def start_at(self, row: dict[str, Any]) -> Builder:
        return self.start_row(row, False)

    def start_after(self, row: dict[str, Any]) -> Builder:
        return self.start_row(row, True)

    def start_row(self, row: dict[str, Any], exclusive: bool) -> Builder:
        return self._with(start=Start(tuple(row.items()), exclusive))

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def one(self) -> Builder:
        return self._with(one=True, limit=1)

    def include(self, *fragments: Fragment) -> Builder:
        """Merge fragments: columns add up, relationships merge by alias."""
        q = self.query
        for f in fragments:
            q = _merged(q, f.query)
        return Builder(q, self.keys)

    def correlated(self, system: str | None = None) -> Related:
        if not self.keys:
            raise Invalid("a child needs a correlation: where(field, parent.field)")
        return Related(tuple(p for _, p in self.keys), tuple(c for c, _ in self.keys), self.query, system)

    def build(self) -> Query:
        return self.query


def _merged(q: Query, f: Query) -> Query:
    if q.table != f.table:
        raise Invalid(f"a fragment of {f.table} can't be included in {q.table}")
    select = q.select if f.select is None else (*(q.select or ()), *(c for c in f.select if c not in (q.select or ())))
    related = list(q.related)
    for r in f.related:
        at = next((i for i, x in enumerate(related) if x.query.alias == r.query.alias), None)
        if at is None:
            related.append(r)
            continue
        old = related[at]
        rows = ("table", "where", "start", "limit", "one", "aggregate", "group_by", "having", "order_by")
        if (old.parent, old.child) != (r.parent, r.child) or any(getattr(old.query, k) != getattr(r.query, k) for k in rows):
            raise Invalid(f"fragments give {r.query.alias!r} different rows")
        bare = r.query.with_(where=None, start=None, limit=None, order_by=(), aggregate=None)
        related[at] = Related(old.parent, old.child, _merged(old.query, bare), old.system)
    return q.with_(select=select, related=tuple(related))


def table(name: str) -> Builder:
    """Start a query."""
    return Builder(Query(name))


@dataclass(frozen=True)
class NamedQuery:
    """A query with validated arguments."""

    name: str
    make: Callable[..., Builder]
    validate: Callable[[Any], Any] | None = None
    local_tables: frozenset[str] = frozenset()

    def __call__(self, arguments: Any = None) -> Query:
        q = self.make(self.validate(arguments) if self.validate else arguments).build()
        used = {q.table, *(r.query.table for r in q.related)}
        if local := used & self.local_tables:
            raise Invalid(f"named query {self.name!r} reads local tables: {', '.join(sorted(local))}")
        return q


def define_query(name: str, make: Callable[..., Builder], validate: Callable[[Any], Any] | None = None, local_tables: tuple[str, ...] = ()) -> NamedQuery:
    """A parameterised query."""
    return NamedQuery(name, make, validate, frozenset(local_tables))
