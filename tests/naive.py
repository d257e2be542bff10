"""Row-at-a-time evaluation of the query language over lists of dicts, to compare with."""

from __future__ import annotations

import functools

from millrace.functions.predicates import fold
from millrace.plans.ast import Gate, Group, Literal, Simple

KEYS = {"artist": ["id"], "album": ["id"], "track": ["id"], "listed": ["list", "track"]}


def holds(data, row, c) -> bool:
    if c is None:
        return True
    if isinstance(c, Simple):
        left = c.left.value if isinstance(c.left, Literal) else row[c.left.name]
        return fold(left, c.op, c.right.value)
    if isinstance(c, Group):
        return (all if c.kind == "and" else any)(holds(data, row, x) for x in c.conditions)
    assert isinstance(c, Gate)
    r = c.related
    if r.query.limit == 0:
        return c.negated
    found = [x for x in data[r.query.table] if matches(row, x, r) and holds(data, x, r.query.where)]
    if r.query.aggregate is not None:
        return bool(found) and fold(len(found), r.query.having.op, r.query.having.right.value)
    return bool(found) != c.negated


def matches(parent, child, r) -> bool:
    return all(parent[p] is not None and parent[p] == child[c] for p, c in zip(r.parent, r.child, strict=True))


def ordered(rows, q):
    order = list(q.order_by) + [(k, "asc") for k in KEYS[q.table] if k not in [c for c, _ in q.order_by]]

    def cmp(a, b):
        for c, way in order:
            x, y = a[c], b[c]
            if x == y:
                continue
            less = (x is None) or (y is not None and x < y)
            return -1 if less == (way == "asc") else 1
        return 0

    rows = sorted(rows, key=functools.cmp_to_key(cmp))
    if q.start is not None:
        bound = {c: None for c, _ in order} | dict(q.start.row)
        rows = [r for r in rows if cmp(r, {**r, **{c: bound[c] for c, _ in order}}) > (0 if q.start.exclusive else -1)]
    return rows


def evaluate(data, q, rows=None):
    rows = data[q.table] if rows is None else rows
    rows = ordered([r for r in rows if holds(data, r, q.where)], q)
    if q.limit is not None:
        rows = rows[: q.limit]
    out = []
    for r in rows:
        related = {x.query.alias: x for x in q.related}
        made = {k: v for k, v in r.items() if k not in related and (q.select is None or k in q.select)}
        for alias, x in related.items():
            children = [c for c in data[x.query.table] if matches(r, c, x)]
            a = x.query.aggregate
            if a is None:
                got = evaluate(data, x.query, children)
                made[alias] = (got[0] if got else None) if x.query.one else got
            else:
                kept = [c for c in children if holds(data, c, x.query.where)]
                values = [c[a.column] for c in kept if c[a.column] is not None] if a.column else []
                made[alias] = len(kept) if a.kind == "count" else (None if not values else sum(values) if a.kind == "sum" else sum(values) / len(values))
        out.append(made)
    return out
