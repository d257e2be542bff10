"""Maintained views: after every batch a view equals its query run afresh.

A batch is netted to one change a key and checked.  Then each view works out
which of its roots the batch can have touched, by walking the correlations from
the changed rows up to the root, evaluates the query for those roots only, and
compares with what it held of them.  Under a root limit the touched rows up to
the last row held are merged with what is held; only where that leaves too few
rows is the query run whole.
Root aggregates over exact types merge signed partial sums; others are summed
afresh, for the touched groups only.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.errors import DeadlineExceeded, Invalid
from millrace.operators import changes as ch
from millrace.operators.aggregates import exact, finished, summed
from millrace.operators.paging import after_texts, completed, first_rows, sort_columns
from millrace.plans.ast import Column as Field
from millrace.plans.ast import Group, Literal, Query, Simple, gates
from millrace.plans.builder import Builder
from millrace.plans.keys import FEW, few
from millrace.plans.lower import Lowering, shown
from millrace.sources.catalog import Catalog, TableDef
from millrace.sources.storage import stored


def built(q: Query | Builder) -> Query:
    """A query of a query or a builder."""
    return q.build() if isinstance(q, Builder) else q


@dataclass
class View:
    """A registered query and its rows."""

    name: str
    query: Query
    engine: Engine
    snapshot: DataFrame | None = None
    state: DataFrame | None = None  # of a root aggregate: accumulators by group
    listeners: list[Callable[[DataFrame | None], None]] = field(default_factory=list)
    status: str = "unknown"
    users: int = 0
    pinned: bool = False
    idle: float = 0.0  # seconds that it is kept without users
    left: float | None = None  # when the last user went
    last: Row | None = None  # under a root limit: the last row held, sort columns as text, where all places are taken

    @property
    def table(self) -> TableDef:
        return self.engine.catalog[self.query.table]

    @property
    def key(self) -> list[str]:
        """What identifies a row of the view."""
        return list(self.query.group_by) if self.query.aggregate else list(self.table.key)

    def hydrate(self) -> View:
        """Evaluate the query whole."""
        self.snapshot = stored(self._fresh(self.engine.catalog))
        self._hold_last()
        if self._merges:
            self.state = stored(self._partials(self.engine.catalog[self.query.table].df))
        self.status = "complete"
        return self

    @property
    def _merges(self) -> bool:
        a = self.query.aggregate
        return a is not None and (a.kind == "count" or exact(self.table.kind(a.column)))

    def _fresh(self, catalog: Catalog, keep: DataFrame | None = None, most: int | None = None) -> DataFrame:
        return Lowering(catalog, self.engine.strict).lower(self.query, keep=keep, project=False, ordered=False, most=most)

    def _hold_last(self) -> None:
        q = self.query
        if q.aggregate is None and q.limit:
            order = completed(q.order_by, self.table)
            rows = self.snapshot.orderBy(*sort_columns(order)).offset(q.limit - 1)
            self.last = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c, _ in order)).head()

    def data(self) -> DataFrame:
        """The view's rows, in its order and columns."""
        if self.snapshot is None:
            raise Invalid(f"view {self.name!r} isn't hydrated")
        q, t = self.query, self.table
        if q.aggregate is not None:
            return self.snapshot
        return shown(self.snapshot.orderBy(*sort_columns(completed(q.order_by, t))), q, t)

    def on_change(self, listener: Callable[[DataFrame | None], None]) -> None:
        """Call the listener after every batch with the changes, and once now with none."""
        self.listeners.append(listener)
        listener(None)

    # --- maintenance --------------------------------------------------------------

    def apply(self, changed: dict[str, tuple[DataFrame, int]], catalog: Catalog) -> DataFrame:
        """The view's ``(op, old, new)`` of a net batch (frames and their numbers of rows) that may matter to it."""
        changed = {n: c for n, c in changed.items() if n in tables_of(self.query)}
        if self.query.aggregate is not None:
            return self._apply_groups(changed[self.query.table][0], catalog)
        touched, most = touched_rows(self.query, changed, self.engine.catalog, catalog, self.key)
        touched = touched.distinct()
        if most is None or most > FEW:
            touched = stored(touched)
            most = touched.count()
        if self.query.limit is not None:
            return self._apply_limited(touched, most, catalog)
        self.engine.counters["views_by_touched_rows"] += 1
        old = self.snapshot.join(few(touched, most), self.key, "left_semi")
        delta = stored(ch.difference(old, self._fresh(catalog, touched, most), self.key))
        self.snapshot = self.engine.settled(ch.replayed(self.snapshot, delta, self.key, most))
        return delta

    def _apply_limited(self, touched: DataFrame, most: int, catalog: Catalog) -> DataFrame:
        """The rows held and the touched ones up to the last row held, in order; the query whole where they are too few."""
        q, t, old = self.query, catalog[self.query.table], self.snapshot
        lowering = Lowering(catalog, self.engine.strict)
        there = old.join(few(touched, most), self.key, "left_anti")
        found = lowering.rows(q, touched, most)
        if self.last is not None:
            found = found.where(~after_texts(self.last.asDict(), completed(q.order_by, t), t))
        pool = there.select(*(F.col(f"`{c}`") for c in t.columns), F.lit(True).alias("__there")).unionByName(found.withColumn("__there", F.lit(False)))
        top = stored(first_rows(pool, q, t))
        if self.last is not None and top.count() < q.limit:
            self.engine.counters["views_whole"] += 1
            new = self._fresh(catalog)
        else:
            self.engine.counters["views_by_touched_rows"] += 1
            stay = there.join(few(top.where("__there").select(*self.key), q.limit), self.key, "left_semi")
            new = stay.unionByName(lowering.nested(q, top.where("not __there").drop("__there"), min(q.limit, most)))
        self.snapshot = stored(new)
        self._hold_last()
        return stored(ch.difference(old, self.snapshot, self.key))

    def may_matter(self, name: str) -> Column | None:
        """Whether a changed row of a table satisfies the equalities that the view asks of it; None if any row may matter."""
        guards = guards_of(self.query, name)
        if None in guards:
            return None
        keep = F.lit(False)
        for g in guards:
            for image in ("before", "after"):
                all_ = F.col(image).isNotNull()
                for c, values in g:
                    all_ = all_ & F.coalesce(F.col(f"{image}.{c}").isin(*values), F.lit(False))
                keep = keep | all_
        return keep

    def _partials(self, rows: DataFrame) -> DataFrame:
        q, t = self.query, self.table
        rows = Lowering(self.engine.catalog, self.engine.strict).where(rows, q.where, t)
        sums = [c.alias(f"__{n}") for n, c in summed(q.aggregate, t)]
        if q.aggregate.kind != "count":
            sums.append(F.count(F.lit(1)).alias("__n"))
        return rows.groupBy(*(F.col(f"`{c}`") for c in q.group_by)).agg(*sums)

    def _apply_groups(self, rows: DataFrame, catalog: Catalog) -> DataFrame:
        q, t = self.query, catalog[self.query.table]
        by = list(q.group_by)
        if self._merges:
            plus = self._partials(rows.where("after is not null").select("after.*"))
            minus = self._partials(rows.where("before is not null").select("before.*"))
            names = [c for c in self.state.columns if c.startswith("__")]
            minus = minus.select(*(F.col(f"`{c}`") for c in by), *((-F.col(c)).alias(c) for c in names))
            every = self.state.unionByName(plus).unionByName(minus)
            merged = every.groupBy(*(F.col(f"`{c}`") for c in by)).agg(*(F.sum(c).cast(self.state.schema[c].dataType).alias(c) for c in names))
            if by:
                merged = merged.where("__n > 0")
            self.state = stored(merged)
            new = self.state.select(*(F.col(f"`{c}`") for c in by), finished(q.aggregate, t, "__").alias(q.aggregate.kind))
            if q.having is not None:
                new = new.where(Lowering(catalog).column(q.having, TableDef(q.table, new, tuple(new.columns)), None))
            new = stored(new)
        else:
            new = stored(self._fresh_groups(rows, catalog, by))
        self.engine.counters["views_by_groups"] += 1
        delta = stored(ch.difference(self.snapshot, new, by)) if by else stored(_single(self.snapshot, new))
        self.snapshot = new
        return delta

    def _fresh_groups(self, rows: DataFrame, catalog: Catalog, by: list[str]) -> DataFrame:
        if not by:
            return self._fresh(catalog)
        groups = rows.where("before is not null").select(*(F.col(f"before.{c}").alias(f"__{c}") for c in by))
        groups = groups.unionByName(rows.where("after is not null").select(*(F.col(f"after.{c}").alias(f"__{c}") for c in by))).distinct()
        same = lambda df: [df[f"`{c}`"].eqNullSafe(groups[f"__{c}"]) for c in by]  # noqa: E731  null is a group
        t = catalog[self.query.table]
        part = catalog.replaced({t.name: t.df.join(groups, same(t.df), "left_semi")})
        return self.snapshot.join(groups, same(self.snapshot), "left_anti").unionByName(self._fresh(part))


def _single(old: DataFrame, new: DataFrame) -> DataFrame:
    pack = lambda df, n: df.select(F.lit(0).alias("k"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(n))
    both = pack(old, "old").join(pack(new, "new"), "k", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(F.lit("edit").alias("op"), "old", "new")


def tables_of(q: Query) -> set[str]:
    """All tables that a query reads."""
    out = {q.table}
    for r in (*q.related, *(g.related for g in gates(q.where))):
        out |= tables_of(r.query)
    return out


def columns_of(q: Query, catalog: Catalog) -> dict[str, list[str]]:
    """The columns of each table that a query shows, with the table's key; a gate shows the key and what it joins on."""
    out: dict[str, list[str]] = {q.table: list(dict.fromkeys((*catalog[q.table].key, *(q.select or catalog[q.table].columns))))}
    below = [columns_of(r.query if r.query.aggregate is None else r.query.with_(select=(*r.child, *filter(None, [r.query.aggregate.column]))), catalog) for r in q.related]
    for g in gates(q.where):
        if g.related.system != "permissions":
            below.append(columns_of(g.related.query.with_(select=tuple(g.related.child)), catalog))
    for found in below:
        for t, c in found.items():
            out[t] = list(dict.fromkeys((*out.get(t, ()), *c)))
    return out


def guards_of(q: Query, table: str) -> list:
    """For each place where a query reads ``table``, the ``(column, values)`` its rows must have; None if any may matter."""
    out: list = []
    if q.table == table:
        found = []
        for c in q.where.conditions if isinstance(q.where, Group) and q.where.kind == "and" else (q.where,) if q.where else ():
            if isinstance(c, Simple) and isinstance(c.left, Field) and isinstance(c.right, Literal) and c.right.value is not None:
                if c.op in ("=", "IS") and isinstance(c.right.value, (str, int)) and not isinstance(c.right.value, bool):
                    found.append((c.left.name, [c.right.value]))
                elif c.op == "IN" and (values := [v for v in c.right.value if v is not None]) and len({type(v) for v in values}) == 1 and isinstance(values[0], (str, int)):
                    found.append((c.left.name, values))
        out.append(found or None)
    for r in (*q.related, *(g.related for g in gates(q.where))):
        out += guards_of(r.query, table)
    return out


def touched_rows(q: Query, changed: dict[str, tuple[DataFrame, int]], before: Catalog, after: Catalog, want: list[str]) -> tuple[DataFrame, int | None]:
    """Columns ``want`` of the rows of a query's table, old or new, below or at which the batch changed something; and a bound on their number, where one is known.

    A row's correlation fields come from its changed children where they are
    all that is wanted, so rows may be named that aren't there.
    """
    t = after[q.table]
    parts: list[tuple[DataFrame, int | None]] = []
    if q.table in changed:
        rows, n = changed[q.table]
        parts += [(rows.where(f"{image} is not null").select(*(F.col(f"{image}.`{c}`").alias(c) for c in want)), n) for image in ("before", "after")]
    for r in (*q.related, *(g.related for g in gates(q.where))):
        if not tables_of(r.query) & set(changed):
            continue
        below, n = touched_rows(r.query, changed, before, after, list(dict.fromkeys(r.child)))
        if set(want) <= set(r.parent):
            child = dict(zip(r.parent, r.child, strict=True))
            same = F.lit(True)
            for p, c in zip(r.parent, r.child, strict=True):
                same = same & F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") == F.col(f"`{child[p]}`"))
            parts.append((below.where(same).select(*(F.col(f"`{child[c]}`").try_cast(t.kind(c)).alias(c) for c in want)), n))
            continue
        keys = few(below.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(r.child))).distinct(), n)
        unique = any(set(u) <= set(r.parent) for u in (t.key, *t.unique))
        for rows in dict.fromkeys((before[q.table].df, after[q.table].df)):
            found = rows.join(keys, [rows[f"`{p}`"] == keys[f"__{i}"] for i, p in enumerate(r.parent)], "left_semi")
            parts.append((found.select(*(F.col(f"`{c}`") for c in want)), n if unique else None))
    if not parts:
        return t.df.where(F.lit(False)).select(*(F.col(f"`{c}`") for c in want)), 0
    out = parts[0][0]
    for p, _ in parts[1:]:
        out = out.unionByName(p)
    return out, None if any(n is None for _, n in parts) else sum(n for _, n in parts)


@contextmanager
def _until(spark: SparkSession, seconds: float | None):
    """Cancel this thread's Spark jobs once the time is over."""
    if seconds is None:
        yield
        return
    context, group = spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
    passed = threading.Event()

    def cancel():
        passed.set()
        context.cancelJobGroup(group)

    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "a batch under a deadline", interruptOnCancel=True)
    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        yield
    except Exception as e:
        if passed.is_set():
            raise DeadlineExceeded(f"the batch took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", before)


class Engine:
    """Tables, queries over them, and views that follow their changes."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, strict: bool = True, compact_every: int = 8):
        self.spark, self.catalog, self.strict, self.compact_every = spark, catalog or Catalog(), strict, compact_every
        self.batches = 0
        self.views: dict[str, View] = {}
        self.last_batch: int | None = None
        self.unnamed = 0
        self.counters: Counter[str] = Counter()

    def register(self, name: str, df: DataFrame, key: list[str] | tuple[str, ...], **options) -> TableDef:
        """Add a table."""
        return self.catalog.register(name, df, key, **options)

    def query(self, q: Query | Builder) -> DataFrame:
        """A query's rows."""
        return Lowering(self.catalog, self.strict).lower(built(q))

    def one(self, q: Query | Builder) -> Row | None:
        """The first row of a query."""
        return self.query(built(q).with_(one=True, limit=1)).head()

    def to_json(self, q: Query | Builder) -> str:
        """The whole result as one JSON document; it comes to the driver, so the query should be bounded."""
        q = built(q)
        rows = self.query(q).toJSON().collect() if q.aggregate else [r[0] for r in self.query(q).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        return (rows[0] if rows else "null") if q.one else f"[{','.join(rows)}]"

    def sql(self, text: str, **args) -> DataFrame:
        """Spark SQL over the registered tables."""
        for n, t in self.catalog.tables.items():
            t.df.createOrReplaceTempView(n)
        return self.spark.sql(text, args=args or None)

    def explain(self, q: Query | Builder) -> str:
        """The plans of a query."""
        return self.query(q)._jdf.queryExecution().toString()

    def analyze(self, q: Query | Builder) -> dict[str, int]:
        """Run a query and count: its rows, and the rows of each table on the way after filters and gates."""
        q = built(q)
        lowering = Lowering(self.catalog, self.strict, footprint=[])
        counts = {"rows": lowering.lower(q, ordered=False).count()}
        for t, rows, _ in lowering.footprint:
            counts[t.name] = counts.get(t.name, 0) + rows.count()
        return counts

    def view(self, q: Query | Builder, name: str | None = None, pinned: bool = False, idle: float = 0.0) -> View:
        """Register and hydrate a view; the same name gives the same view.

        A pinned view stays when its last user gives it up; another one is kept
        for ``idle`` seconds (the longest asked for), see :meth:`expire`.
        """
        q = built(q)
        while name is None:
            name = f"view{self.unnamed}" if f"view{self.unnamed}" not in self.views else None
            self.unnamed += 1
        if name not in self.views:
            self.views[name] = View(name, q, self).hydrate()
        v = self.views[name]
        v.users, v.left = v.users + 1, None
        v.pinned, v.idle = v.pinned or pinned, max(v.idle, idle)
        return v

    def drop(self, name: str) -> None:
        """Give a view up; it goes with its last user, or later where it may be idle."""
        v = self.views[name]
        v.users -= 1
        if v.users <= 0 and not v.pinned:
            if v.idle:
                v.left = time.monotonic()
            else:
                del self.views[name]

    def expire(self, now: float | None = None) -> list[str]:
        """Let the views go that nobody has used for as long as they may be idle; their names.

        ``now`` is in seconds of the monotonic clock.  Batches do this first.
        """
        now = time.monotonic() if now is None else now
        gone = [n for n, v in self.views.items() if v.left is not None and not v.pinned and now - v.left >= v.idle]
        for n in gone:
            del self.views[n]
        return gone

    def apply(self, batch: dict[str, DataFrame], batch_id: int | None = None, deadline: float | None = None) -> dict[str, DataFrame]:
        """Apply a batch (table to changes) to tables and views; each view's changes by name.

        Nothing is changed if the batch is refused or the deadline (in seconds)
        passes: then the job that runs is cancelled.  A batch whose id isn't
        above the last one's is skipped.
        """
        if batch_id is not None and self.last_batch is not None and batch_id <= self.last_batch:
            self.counters["batches_skipped"] += 1
            return {}
        began = time.monotonic()
        self.expire(began)
        kept = {n: (v.snapshot, v.state, v.last) for n, v in self.views.items()}
        counted, begun = Counter(self.counters), False
        out: dict[str, DataFrame] = {}
        try:
            with _until(self.spark, deadline):
                changed = {n: ch.net_counted(self.catalog[n], df) for n, df in batch.items()}
                changed = {n: c for n, c in changed.items() if c[1]}
                after = self.catalog.replaced({n: self.settled(ch.applied(self.catalog[n], *c)) for n, c in changed.items()})
                begun = True
                for v in self._mattering({n: c for n, (c, _) in changed.items()}):
                    if deadline is not None and time.monotonic() - began > deadline:
                        raise DeadlineExceeded(f"the batch took more than {deadline} s")
                    out[v.name] = v.apply(changed, after)
        except Exception:
            self.counters = counted
            self.counters["batches_refused"] += 1
            for n, (snapshot, state, last) in kept.items():
                v = self.views[n]
                v.snapshot, v.state, v.last = snapshot, state, last
                v.status = "error" if begun else v.status
            raise
        self.catalog, self.last_batch = after, batch_id if batch_id is not None else self.last_batch
        self.batches += 1
        self.counters["batches"] += 1
        self.counters.update({f"rows_changed.{n}": c for n, (_, c) in changed.items()})
        self.counters["views_untouched"] += len(self.views) - len(out)
        self.counters["apply_ms"] += round(1000 * (time.monotonic() - began))
        for v in self.views.values():
            v.status = "complete"
        for name, delta in out.items():
            for listener in self.views[name].listeners:
                listener(delta)
        return out

    def _mattering(self, changed: dict[str, DataFrame]) -> list[View]:
        """The views that the batch may matter to; a changed table is read once for all their guards."""
        matter: set[str] = set()
        for table, rows in changed.items():
            asked = {n: v.may_matter(table) for n, v in self.views.items() if table in tables_of(v.query)}
            matter |= {n for n, keep in asked.items() if keep is None}
            names = [n for n in asked if n not in matter]
            if names:
                matter |= {n for n, hit in zip(names, rows.agg(*(F.max(asked[n]) for n in names)).first(), strict=True) if hit}
        return [v for n, v in self.views.items() if n in matter]

    def metrics(self) -> DataFrame:
        """``(name, value)`` of what has been counted: batches, changed rows by table, how views were maintained, time."""
        return self.spark.createDataFrame(sorted(self.counters.items()), "name string, value long")

    def settled(self, df: DataFrame) -> DataFrame:
        """Tables and snapshots after a batch: the frame before it, less the rows that changed, and their new images.

        These layers are small beside the frame below them.  Every
        ``compact_every`` batches the whole is stored, so that plans stay short.
        """
        return stored(df) if self.batches % self.compact_every == self.compact_every - 1 else df

    def transaction(self) -> Transaction:
        """Stage several writes and apply them as one batch."""
        return Transaction(self)

    def fork(self) -> Engine:
        """Another engine with the same tables and no views; frames don't change, so nothing is copied."""
        return Engine(self.spark, Catalog(dict(self.catalog.tables)), self.strict, self.compact_every)

    def footprint(self, q: Query | Builder) -> DataFrame:
        """``(table, key, n)``: the base rows that a query's result rests on, keys as JSON; witnesses of permission gates don't count."""
        q = built(q)
        lowering = Lowering(self.catalog, self.strict, footprint=[], held=True)
        lowering.lower(q, ordered=False)
        out = None
        for t, rows, system in lowering.footprint:
            if system == "permissions":
                continue
            one = rows.select(F.lit(t.name).alias("table"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in t.key))).alias("key")).distinct()
            out = one if out is None else out.unionByName(one)
        return out.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))

    def held(self) -> DataFrame:
        """``(table, key, n, present)``: the base rows that registered views rest on, the number of those views, and the columns that any of them reads.

        A row that no view holds any more is absent: what a copy of the base
        rows may let go after a change is ``before`` left anti joined with this.
        """
        out = self.spark.createDataFrame([], "table string, key string, present array<string>")
        for v in self.views.values():
            columns = columns_of(v.query, self.catalog)
            shown_ = F.create_map(*(x for t, c in columns.items() for x in (F.lit(t), F.array(*map(F.lit, c)))))
            out = out.unionByName(self.footprint(v.query).select("table", "key", shown_[F.col("table")].alias("present")))
        return out.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("present")))).alias("present"))


class Transaction:
    """Writes that become visible together; reads inside see them."""

    def __init__(self, engine: Engine):
        self.engine, self.batch, self.steps = engine, {}, 0

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.commit()

    def write(self, table: str, changes: DataFrame) -> None:
        """Stage changes after those staged before."""
        self.steps += 1
        later = changes.withColumn("seq", F.col("seq") + F.lit(self.steps * (1 << 40)))
        self.batch[table] = self.batch[table].unionByName(later) if table in self.batch else later

    @property
    def catalog(self) -> Catalog:
        """The tables with the staged writes."""
        base = self.engine.catalog
        return base.replaced({n: ch.applied(base[n], ch.net(base[n], df)) for n, df in self.batch.items()})

    def query(self, q: Query | Builder) -> DataFrame:
        """A query that sees the staged writes."""
        return Lowering(self.catalog, self.engine.strict).lower(built(q))

    def commit(self) -> dict[str, DataFrame]:
        """Apply what is staged."""
        batch, self.batch = self.batch, {}
        return self.engine.apply(batch) if batch else {}

    def rollback(self) -> None:
        """Forget what is staged."""
        self.batch = {}


