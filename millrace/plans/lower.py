"""From a query to a DataFrame.

The order of steps is start, filters and gates, limit, then nested children, so
that children are only read for the rows that stay.  Everything is checked
before a frame is made: a query that can't be built starts no job.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import Invalid, Unsupported
from millrace.functions.predicates import predicate, simple
from millrace.operators.aggregates import aggregated, checked
from millrace.operators.paging import completed, first_rows, from_start, ranked, sort_columns
from millrace.plans.ast import Column as Field
from millrace.plans.ast import Condition, Gate, Group, Literal, Query, Related, Simple, gates
from millrace.plans.keys import few
from millrace.sources.catalog import Catalog, TableDef

_ids = itertools.count()


def _unique(name: str) -> str:
    return f"__{name}{next(_ids)}"


@dataclass
class Lowering:
    """How queries become frames.

    ``strict`` refuses what the language refuses although Spark could do it;
    ``by_byte`` lets ``_`` in patterns stand for a byte.
    """

    catalog: Catalog
    strict: bool = True
    by_byte: bool = False
    footprint: list[tuple[TableDef, DataFrame, str | None]] | None = field(default=None, repr=False)
    held: bool = False  # a footprint of the rows that the result rests on alone, not of all that are read

    # --- checks -----------------------------------------------------------------

    def check(self, q: Query, root: bool = True) -> None:
        """Raise what is wrong with a query."""
        t = self.catalog[q.table]
        completed(q.order_by, t)
        for c in (*(q.select or ()), *q.group_by):
            t.kind(c)
        for c, _ in q.start.row if q.start else ():
            t.kind(c)
        if q.limit is not None and q.limit < 0:
            raise Invalid("a limit is not negative")
        self._check_condition(q.where, t)
        if q.aggregate is not None:
            checked(q.aggregate, t) if not q.precomputed else None
            if q.related:
                raise Unsupported("an aggregate has no nested children")
            if root:
                self._check_root_aggregate(q)
            elif q.limit is not None or q.start is not None:
                raise Unsupported("an aggregate of children folds all of them: no start, no limit")
        elif q.group_by or (q.having is not None and root):
            raise Invalid("group_by and having need an aggregate")
        for r in q.related:
            if r.query.alias is None:
                raise Invalid("a nested child needs an alias")
            self._check_correlation(r, t)
            self.check(r.query, root=False)
        if self.strict:
            shown = {r.query.alias for r in q.related}
            for g in gates(q.where):
                if g.related.query.alias in shown and g.related.query.alias is not None and g.related.query.having is None:
                    raise Unsupported(f"a gate and a nested child are both called {g.related.query.alias!r}")

    def _check_root_aggregate(self, q: Query) -> None:
        if q.select is not None or q.one:
            raise Unsupported("an aggregate has its own columns: no select, no one()")
        if q.order_by or q.limit is not None or q.start is not None:
            raise Unsupported("an aggregate is not ordered or paged")
        if any(True for _ in gates(q.where)) or any(True for _ in gates(q.having)):
            raise Unsupported("an aggregate has no gates in where or having")

    def _check_correlation(self, r: Related, parent: TableDef) -> None:
        if not r.parent or len(r.parent) != len(r.child):
            raise Invalid("a correlation has as many parent as child fields, and some")
        for c in r.parent:
            parent.kind(c)
        for c in r.child:
            self.catalog[r.query.table].kind(c)

    def _check_condition(self, c: Condition | None, t: TableDef) -> None:
        if isinstance(c, Simple):
            simple(c, lambda n: (F.lit(None).cast(t.kind(n)), t.kind(n)), self.by_byte)
        elif isinstance(c, Group):
            for x in c.conditions:
                self._check_condition(x, t)
        elif isinstance(c, Gate):
            self._check_correlation(c.related, t)
            q = c.related.query
            if q.aggregate is not None:
                _count_gate(c)
            elif not c.flip and (q.start is not None or q.related):
                raise Unsupported("a gate's children are not paged and have no children of their own")
            if c.flip and c.negated and self.strict:
                raise Unsupported("NOT EXISTS can't be flipped")
            self.check(q.with_(aggregate=None, having=None, related=(), order_by=(), limit=None), root=False)

    # --- rows -------------------------------------------------------------------

    def rows(self, q: Query, keep: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """The rows of a query's table after start and where, before any limit, in all columns.

        ``keep`` has the keys to stay with, ``most`` bounds how many.
        """
        t = self.catalog[q.table]
        df = t.df if keep is None else t.df.join(few(keep, most), list(t.key), "left_semi")
        return self.where(from_start(df, q, t), q.where, t)

    def where(self, df: DataFrame, c: Condition | None, t: TableDef) -> DataFrame:
        """Rows that satisfy a condition: comparisons filter, gates that must hold are semi or anti joins."""
        if c is None:
            return df
        parts = list(_conjuncts(c))
        for p in parts:
            if not any(True for _ in gates(p)):
                df = df.where(self.column(p, t, None))
        for p in parts:
            if isinstance(p, Gate):
                df = self._gate_join(df, p)
            elif any(True for _ in gates(p)):
                name = _unique("p")
                df = df.alias(name).where(self.column(p, t, name))
        return df

    def column(self, c: Condition, t: TableDef, outer: str | None) -> Column:
        """A condition as a column; gates in it are existence subqueries of the frame called ``outer``."""
        if isinstance(c, Simple):
            return simple(c, lambda n: (F.col(f"{outer}.`{n}`" if outer else f"`{n}`"), t.kind(n)), self.by_byte)
        if isinstance(c, Group):
            out = F.lit(c.kind == "and")
            for x in c.conditions:
                out = out & self.column(x, t, outer) if c.kind == "and" else out | self.column(x, t, outer)
            return out
        fixed = self._settled(c)
        if isinstance(fixed, bool):
            return F.lit(fixed)
        if not isinstance(fixed, Gate):
            return self.column(fixed, t, outer)
        keys, child = self._gate_keys(c)
        on = F.lit(True)
        for p, k in zip(c.related.parent, keys, strict=True):
            on = on & (F.col(f"`{k}`") == F.col(f"{outer}.`{p}`").outer())
        found = child.where(on).exists()
        return ~found if c.negated else found

    def _gate_join(self, df: DataFrame, g: Gate) -> DataFrame:
        fixed = self._settled(g)
        if isinstance(fixed, bool):
            return df if fixed else df.where(F.lit(False))
        if not isinstance(fixed, Gate):
            return self.where(df, fixed, self.catalog_of(df, g))
        keys, child = self._gate_keys(g)
        on = [df[f"`{p}`"] == child[f"`{k}`"] for p, k in zip(g.related.parent, keys, strict=True)]
        return df.join(child, on, "left_anti" if g.negated else "left_semi")

    def catalog_of(self, df: DataFrame, g: Gate) -> TableDef:
        """A table definition that types the columns of ``df``, for conditions that a gate folds to."""
        return TableDef("", df, tuple(df.columns[:1]))

    def _gate_keys(self, g: Gate) -> tuple[list[str], DataFrame]:
        """A gate's children as their correlation fields alone, under fresh names."""
        q = g.related.query
        t = self.catalog[q.table]
        rows = self.rows(q if g.flip else q.with_(start=None))
        if self.footprint is not None and not self.held:
            self.footprint.append((t, rows, g.related.system))
        keys = [_unique("k") for _ in g.related.child]
        if q.aggregate is not None:
            op, n = _count_gate(g)
            name = _unique("n")
            rows = rows.groupBy(*(F.col(f"`{c}`") for c in dict.fromkeys(g.related.child))).agg(F.count(F.lit(1)).alias(name))
            rows = rows.where(predicate(F.col(name), T.LongType(), op, n))
        return keys, rows.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(g.related.child, keys, strict=True)))

    def _settled(self, g: Gate) -> Condition | bool:
        """A gate that is known without a join: a zero limit, or a scalar lookup."""
        if g.related.query.limit == 0:
            return g.negated
        if not g.scalar:
            return g
        q, t = g.related.query, self.catalog[g.related.query.table]
        # gates within are looked up first; what a lookup leaves is a set of equalities
        where = self._scalar_inside(q.where)
        if where is False:
            return g.negated
        bound: dict[str, object] = {}
        for c in _conjuncts(where) if where is not None and where is not True else ():
            if not (isinstance(c, Simple) and c.op == "=" and isinstance(c.left, Field) and isinstance(c.right, Literal)):
                raise Unsupported("a scalar gate's where is a conjunction of column = literal")
            if bound.setdefault(c.left.name, c.right.value) != c.right.value:
                return g.negated
        if not any(set(bound) == set(u) for u in (t.key, *t.unique)):
            raise Unsupported("a scalar gate binds exactly a unique key")
        if g.negated and len(g.related.parent) != 1:
            raise Unsupported("a scalar NOT EXISTS has one correlation field")
        found = self.rows(q.with_(where=where if where is not True else None)).select(*(F.col(f"`{c}`") for c in g.related.child)).head(1)
        if not found:
            return g.negated
        values = [Simple("IS NOT" if g.negated else "=", Field(p), Literal(v)) for p, v in zip(g.related.parent, found[0], strict=True)]
        return values[0] if len(values) == 1 else Group("and", tuple(values))

    def _scalar_inside(self, c: Condition | None) -> Condition | bool | None:
        if isinstance(c, Gate):
            return self._settled(c)
        if isinstance(c, Group) and c.kind == "and":
            parts = [self._scalar_inside(x) for x in c.conditions]
            if any(p is False for p in parts):
                return False
            return Group("and", tuple(p for p in parts if p is not True))
        return c

    def _rests_on(self, q: Query, rows: DataFrame, system: str | None = None) -> None:
        """Note a query's rows and, where asked for what is held, the rows that its gates found for them."""
        if self.footprint is None:
            return
        self.footprint.append((self.catalog[q.table], rows, system))
        for g in gates(q.where) if self.held else ():
            if g.negated:
                continue
            inner = g.related.query
            at = [_unique("w") for _ in g.related.parent]
            keys = rows.select(*(F.col(f"`{p}`").alias(w) for p, w in zip(g.related.parent, at, strict=True))).distinct()
            found = self.rows(inner if g.flip else inner.with_(start=None))
            found = found.join(keys, [found[f"`{c}`"] == keys[w] for c, w in zip(g.related.child, at, strict=True)], "left_semi")
            self._rests_on(inner, found, system or g.related.system)

    # --- shapes -----------------------------------------------------------------

    def nested(self, q: Query, df: DataFrame, most: int | None = None, narrow: bool = False) -> DataFrame:
        """``df`` with its children attached, each in a column ``@alias`` after the table's own.

        ``most`` bounds the rows of ``df``.  Where there is a bound, or with
        ``narrow``, only the children of the rows at hand are read.
        """
        t = self.catalog[q.table]
        self._rests_on(q, df)
        whole, given = df, _given(q)
        for r in _children(q):
            df = self._attach(df, r, f"@{r.query.alias}", whole if narrow or most is not None else None, most, given)
        return df

    def _attach(self, df: DataFrame, r: Related, name: str, parents: DataFrame | None = None, most: int | None = None, given: dict[str, object] | None = None) -> DataFrame:
        q = r.query
        t = self.catalog[q.table]
        keys = [_unique("c") for _ in r.child]
        named = [F.col(f"`{c}`").alias(k) for c, k in zip(r.child, keys, strict=True)]
        rows = self.rows(q)
        for p, c in zip(r.parent, r.child, strict=True):
            if given and p in given:
                rows = rows.where(self.column(Simple("=", Field(c), Literal(given[p])), t, None))
        if parents is not None:
            here = [_unique("h") for _ in r.parent]
            at = few(parents.select(*(F.col(f"`{p}`").alias(h) for p, h in zip(r.parent, here, strict=True))).distinct(), most)
            rows = rows.join(at, [rows[f"`{c}`"] == at[h] for c, h in zip(r.child, here, strict=True)], "left_semi")
        if q.precomputed:
            value = [c for c in t.columns if c not in r.child]
            child = rows.select(*named, F.col(f"`{value[-1]}`").alias(name))
        elif q.aggregate is not None:
            self._rests_on(q, rows)
            child = aggregated(rows, q.aggregate, t, list(dict.fromkeys(r.child))).select(*named, F.col(q.aggregate.kind).alias(name))
        else:
            if q.limit == 0:
                rows = rows.where(F.lit(False))
            order, rank = completed(q.order_by, t), _unique("o")
            rows = ranked(rows, order, list(r.child), rank, 1 if q.one else q.limit or None)
            ranks = rows.select(F.col(rank), *(F.col(f"`{c}`") for c in t.columns))
            each = 1 if q.one or set(t.key) <= set(r.child) else q.limit
            payload = self._child_rows(q, ranks, rank, r, parents is not None, None if most is None or each is None else most * each)
            child = payload.groupBy(*keys_of(payload, len(keys))).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("o"), F.col("__v").alias("v")))).alias(name))
            child = child.toDF(*keys, name).withColumn(name, F.transform(F.col(f"`{name}`"), lambda x: x["v"]))
        child = child.where(" and ".join(f"{k} is not null" for k in keys))
        out = df.join(child, [df[f"`{p}`"] == child[k] for p, k in zip(r.parent, keys, strict=True)], "left")
        out = out.select(*(df[f"`{c}`"] for c in df.columns), child[f"`{name}`"])
        if q.aggregate is not None:
            return out.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(0))) if q.aggregate.kind == "count" else out
        kind = child.schema[name].dataType
        if q.one:
            return out.withColumn(name, F.try_element_at(F.col(f"`{name}`"), F.lit(1)))
        return out.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(kind)))

    def _child_rows(self, q: Query, rows: DataFrame, rank: str, r: Related, narrow: bool, most: int | None) -> DataFrame:
        """Correlation fields, rank and payload of the child rows, with their own children in it."""
        t = self.catalog[q.table]
        keys = [_unique("x") for _ in r.child]
        kept = [F.col(f"`{c}`").alias(k) for c, k in zip(r.child, keys, strict=True)]
        rows = rows.select(*kept, F.col(rank), *(F.col(f"`{c}`") for c in t.columns))
        self._rests_on(q, rows)
        related = _children(q)
        names = [x.query.alias for x in related]
        made, whole = [], rows
        for x in related:
            name = _unique("r")
            rows = self._attach(rows, x, name, whole if narrow else None, most, _given(q))
            made.append(F.col(name).alias(x.query.alias))
        shown = [c for c in (q.select if q.select is not None else t.columns) if c not in names]
        return rows.select(*keys, rank, F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys(shown)), *made).alias("__v"))

    def lower(self, q: Query, keep: DataFrame | None = None, project: bool = True, ordered: bool = True, most: int | None = None) -> DataFrame:
        """The query's frame; with ``keep`` (keys of the root table, ``most`` of them) only of those rows."""
        self.check(q)
        t = self.catalog[q.table]
        if q.aggregate is not None:
            rows = self.rows(q, keep, most)
            self._rests_on(q, rows)
            df = aggregated(rows, q.aggregate, t, list(q.group_by))
            return df if q.having is None else df.where(self.column(q.having, TableDef(q.table, df, tuple(df.columns)), None))
        df = first_rows(self.rows(q, keep, most), q, t)
        bounds = [n for n in (most, q.limit, 1 if set(t.key) <= set(_given(q)) else None) if n is not None]
        out = self.nested(q, df, min(bounds, default=None), narrow=keep is not None or self.held)
        if ordered:
            out = out.orderBy(*sort_columns(completed(q.order_by, t)))
        return shown(out, q, t) if project else out


def shown(df: DataFrame, q: Query, t: TableDef) -> DataFrame:
    """The columns that a query asks for, of a frame with children in ``@alias`` columns; an alias hides a column of its name."""
    aliases = [r.query.alias for r in _children(q)]
    own = [c for c in (q.select if q.select is not None else t.columns) if c not in aliases]
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(own)), *(F.col(f"`@{a}`").alias(a) for a in aliases))


def _children(q: Query) -> list[Related]:
    """A query's nested children; of several with one alias, the last."""
    return list({r.query.alias: r for r in q.related}.values())


def keys_of(df: DataFrame, n: int) -> list[Column]:
    """The first ``n`` columns."""
    return [F.col(f"`{c}`") for c in df.columns[:n]]


def _given(q: Query) -> dict[str, object]:
    """The columns that a query binds to one value."""
    return {c.left.name: c.right.value for c in (_conjuncts(q.where) if q.where is not None else ()) if isinstance(c, Simple) and c.op == "=" and isinstance(c.left, Field) and isinstance(c.right, Literal) and c.right.value is not None}


def _conjuncts(c: Condition):
    if isinstance(c, Group) and c.kind == "and":
        for x in c.conditions:
            yield from _conjuncts(x)
    else:
        yield c


def _count_gate(g: Gate) -> tuple[str, object]:
    """The operator and number of a gate over a child count."""
    q, h = g.related.query, g.related.query.having
    if q.aggregate.kind != "count":
        raise Unsupported("only a count of children can be a gate")
    if g.negated:
        raise Unsupported("a count gate can't be negated")
    if q.related or q.start is not None or q.limit is not None or q.order_by:
        raise Unsupported("a count gate folds all children: no page, order, limit or children of them")
    if not (isinstance(h, Simple) and isinstance(h.left, Field) and h.left.name == "count"):
        raise Unsupported("a count gate compares its count with a number")
    n = h.right.value if isinstance(h.right, Literal) else None
    if isinstance(n, bool) or not isinstance(n, (int, float)) or h.op not in ("=", "!=", "<", "<=", ">", ">="):
        raise Unsupported("a count gate compares its count with a number")
    if {"=": n == 0, "!=": n != 0, "<": n > 0, "<=": n >= 0, ">": n < 0, ">=": n <= 0}[h.op]:
        raise Unsupported("a count gate must be false for a parent without children")
    return h.op, n
