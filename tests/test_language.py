"""Queries over a small music store against row-at-a-time evaluation."""

from __future__ import annotations

import itertools
import time

import pytest
from pyspark.sql import functions as F

from millrace.errors import ConsistencyViolation, DeadlineExceeded, Invalid, SchemaViolation, UnknownColumn, UnknownRelationship, UnknownTable, Unsupported
from millrace.functions.predicates import spark_pattern
from millrace.functions.text import aggregate_name, epoch_ms, narrated
from millrace.operators import changes as ch
from millrace.plans.advice import advise_layout, explain_gates
from millrace.plans.ast import from_json, to_json
from millrace.plans.builder import all_of, any_of, compare, eq, exists, fragment, gt, ilike, in_list, is_null, like, not_exists, not_in_list, not_like, table
from millrace.plans.lower import Lowering
from millrace.sources.catalog import Catalog, checked
from millrace.streaming.driver import assembled_text, chunked_text, spliced_text
from millrace.streaming.subscription import Publisher, SequenceGap, Subscriber
from millrace.streaming.views import Engine
from tests.naive import KEYS, evaluate

DATA = {
    "artist": [{"id": i, "name": n, "country": c} for i, n, c in [(1, "Ann", "de"), (2, "bob", None), (3, "Cé%", "fr"), (4, "dora", "de"), (5, "É_a", None)]],
    "album": [{"id": i, "artist": a, "title": t, "year": y} for i, a, t, y in [(10, 1, "x", 1999), (11, 1, "y", None), (12, 2, "z", 2005), (13, 3, "x", 2005), (14, None, "lost", 1980)]],
    "track": [{"id": i, "album": a, "ms": m, "price": p} for i, a, m, p in [(100, 10, 5, 0.5), (101, 10, 9, None), (102, 10, 5, 1.5), (103, 12, 7, 2.0), (104, 13, None, 1.0), (105, 13, 3, 1.0), (106, None, 1, 1.0)]],
    "listed": [{"list": x, "track": t} for x, t in [(1, 100), (1, 103), (2, 100), (2, 106)]],
}
SCHEMAS = {
    "artist": "id long, name string, country string",
    "album": "id long, artist long, title string, year int",
    "track": "id long, album long, ms long, price double",
    "listed": "list long, track long",
}


def store(spark, data=DATA) -> Catalog:
    c = Catalog()
    for n, rows in data.items():
        c.register(n, spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMAS[n]).coalesce(1), KEYS[n], unique=(("title", "year"),) if n == "album" else ())
    return c


albums = lambda p: table("album").where("artist", p.id)
tracks = lambda p: table("track").where("album", p.id)

SHAPES = {
    "flat": lambda q: q,
    "select": lambda q: q.select("name"),
    "nested": lambda q: q.sub("albums", albums),
    "two levels": lambda q: q.sub("albums", lambda p: albums(p).order_by("year", "desc").sub("tracks", lambda p: tracks(p).order_by("ms").limit(2))),
    "one": lambda q: q.sub("first", lambda p: albums(p).order_by("year").one()),
    "child start": lambda q: q.sub("albums", lambda p: albums(p).order_by("year").start_after({"year": 1999, "id": 10})),
    "counts": lambda q: q.count_as("n", albums).sum_as("years", "year", albums).avg_as("mean", "year", albums),
    "count gate": lambda q: q.count_as("n", albums).having_count("n", ">=", 2),
    "exists": lambda q: q.where_exists(albums),
    "not exists": lambda q: q.where_not_exists(albums),
    "chain": lambda q: q.where_exists(lambda p: albums(p).where_not_exists(tracks)),
    "or": lambda q: q.where_any(exists(lambda p: albums(p).where(gt("year", 2000))), eq("country", "de")),
    "or not": lambda q: q.where_any(not_exists(albums), exists(lambda p: albums(p).where_exists(tracks, lambda b: b.where(gt("ms", 6))), flip=True)),
    "limit zero": lambda q: q.where_any(exists(lambda p: albums(p).limit(0)), eq("id", 1)),
}
FILTERS = {
    "none": None, "eq": eq("country", "de"), "null": is_null("country"), "in": in_list("id", [1, 3, None]), "not in": not_in_list("country", ["de", None]),
    "like": like("name", "%\\%"), "not like": not_like("name", "%o%"), "ilike": ilike("name", "BO%"), "under": like("name", "É__"),
    "nested": all_of(any_of(eq("country", "fr"), is_null("country")), any_of(gt("id", 2.5), compare("name", "<", "b"))),
}
ORDERS = {"key": lambda q: q, "desc": lambda q: q.order_by("country", "desc"), "limited": lambda q: q.order_by("name").limit(3), "start": lambda q: q.order_by("country").start_after({"country": None, "id": 2})}


def cases():
    shapes, filters, orders = list(SHAPES), list(FILTERS), list(ORDERS)
    for i, s in enumerate(shapes):
        for j in range(3):
            yield s, filters[(i + 4 * j) % len(filters)], orders[(i + j) % len(orders)]


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def made(shape, filter_, order):
    q = SHAPES[shape](table("artist"))
    if FILTERS[filter_] is not None:
        q = q.where(FILTERS[filter_])
    return ORDERS[order](q).build()


@pytest.mark.parametrize(("shape", "filter_", "order"), list(cases()))
def test_matches_row_at_a_time(spark, shape, filter_, order):
    q = made(shape, filter_, order)
    assert from_json(to_json(q)) == q
    assert plain(Lowering(store(spark)).lower(q).collect()) == evaluate(DATA, q)


def test_exact_numbers(spark):
    big = 2**53
    df = spark.createDataFrame([(1, big + 1, float(big)), (2, big, 0.5), (3, -(2**63), -1.0)], "id long, i long, d double")
    c = Catalog()
    c.register("n", df, ["id"])

    def ids(condition):
        return sorted(r[0] for r in Lowering(c).lower(table("n").where(condition).select("id").build()).collect())

    assert ids(eq("i", float(big))) == [2]
    assert ids(compare("d", "<", big + 1)) == [1, 2, 3]
    assert ids(eq("d", big + 1)) == []
    assert ids(gt("i", 1e300)) == []
    assert ids(compare("i", ">=", -1e300)) == [1, 2, 3]
    assert ids(compare("i", "<", 0.5)) == [3]
    assert ids(in_list("d", [0.5, "0.5", big + 1])) == [2]
    assert ids(compare("d", "!=", 0.5)) == [1, 3]


def test_patterns():
    assert spark_pattern("a\\b\\%\\") == "a\\\\b\\%\\\\"
    assert spark_pattern("\\\\_") == "\\\\_"


def test_like_by_byte(spark):
    q = table("artist").where(like("name", "_a")).select("id").build()
    assert Lowering(store(spark), by_byte=False).lower(q).count() == 0
    q = table("artist").where(like("name", "___a")).select("id").build()
    assert [r[0] for r in Lowering(store(spark), by_byte=True).lower(q).collect()] == [4, 5]


def test_sum_overflow(spark):
    c = Catalog()
    c.register("n", spark.createDataFrame([(1, 2**63 - 1), (2, 1), (3, -5)], "id long, v long"), ["id"])
    assert Lowering(c).lower(table("n").sum("v").build()).head()[0] == 2**63 - 1 + 1 - 5
    with pytest.raises(Exception, match="SUM_OVERFLOW"):
        Lowering(c).lower(table("n").where(gt("v", 0)).sum("v").build()).collect()


@pytest.mark.parametrize(
    ("query", "error"),
    [
        (table("nope"), UnknownTable),
        (table("artist").where("nope", 1), UnknownColumn),
        (table("artist").select("nope"), UnknownColumn),
        (table("artist").order_by("nope"), UnknownColumn),
        (table("artist").order_by("id", "up"), Invalid),
        (table("artist").count().limit(3), Unsupported),
        (table("artist").count().select("id"), Unsupported),
        (table("artist").count().where(exists(albums)), Unsupported),
        (table("artist").where(exists(lambda p: albums(p).start_after({"id": 1}))), Unsupported),
        (table("artist").where(not_exists(albums, flip=True)), Unsupported),
        (table("artist").sub("a", albums).where_exists(lambda p: albums(p)._with(alias="a")), Unsupported),
        (table("artist").count_as("n", albums).having_count("n", "<", 3), Unsupported),
        (table("artist").group_by("country"), Invalid),
        (table("artist").where(compare("id", "IN", 3)), Invalid),
        (table("artist").limit(-1), Invalid),
    ],
)
def test_refused_before_any_job(spark, query, error):
    with pytest.raises(error):
        Lowering(store(spark)).lower(query.build())


def test_builder_refusals():
    with pytest.raises(UnknownRelationship):
        table("artist").having_count("n", ">", 1)
    with pytest.raises(Invalid):
        table("artist").sub("a", lambda p: table("album"))
    with pytest.raises(Invalid):
        fragment(table("artist").limit(1))
    with pytest.raises(Invalid):
        table("artist").include(fragment(table("artist").sub("a", albums)), fragment(table("artist").sub("a", lambda p: albums(p).limit(1))))


def test_scalar_gate_reads_once(spark):
    q = table("artist").where_exists(lambda p: albums(p).where("id", 12), scalar=True).build()
    assert [r.id for r in Lowering(store(spark)).lower(q).collect()] == [2]
    assert explain_gates(q) == ["album by artist: literal filter after one lookup"]


def batch_for(c: Catalog, spark):
    def rows(name, *values):
        return spark.createDataFrame(list(values), SCHEMAS[name])

    a, b, t = c["artist"], c["album"], c["track"]
    return {
        "artist": ch.removes(a, a.df.where("id = 3")).unionByName(ch.adds(a, rows("artist", (6, "eve", "de")))).unionByName(ch.edits(a, a.df.where("id = 2"), rows("artist", (2, "Bob", "fr")))),
        "album": ch.edits(b, b.df.where("id = 10"), rows("album", (10, 4, "x", 2010))).unionByName(ch.adds(b, rows("album", (15, 6, "new", 2020), (16, 1, "w", 1990)))),
        "track": ch.removes(t, t.df.where("id in (103)")).unionByName(ch.adds(t, rows("track", (110, 15, 8, 1.0), (111, 11, 2, None)))),
    }


def after_batch():
    data = {k: [dict(r) for r in v] for k, v in DATA.items()}
    data["artist"] = [r for r in data["artist"] if r["id"] not in (2, 3)] + [{"id": 2, "name": "Bob", "country": "fr"}, {"id": 6, "name": "eve", "country": "de"}]
    data["album"] = [r for r in data["album"] if r["id"] != 10] + [{"id": i, "artist": a, "title": t, "year": y} for i, a, t, y in [(10, 4, "x", 2010), (15, 6, "new", 2020), (16, 1, "w", 1990)]]
    data["track"] = [r for r in data["track"] if r["id"] != 103] + [{"id": 110, "album": 15, "ms": 8, "price": 1.0}, {"id": 111, "album": 11, "ms": 2, "price": None}]
    return data


def test_views_follow_changes(spark):
    e = Engine(spark, store(spark))
    views, before = {}, {}
    for s, o in itertools.zip_longest(SHAPES, ("key", "limited"), fillvalue="key"):
        views[s] = e.view(made(s, "none", o), s)
        before[s] = views[s].snapshot
    seen = []
    views["two levels"].on_change(seen.append)
    deltas = e.apply(batch_for(e.catalog, spark))
    for s, v in views.items():
        assert plain(v.data().collect()) == evaluate(after_batch(), v.query), s
        if s in deltas:
            again = ch.replayed(before[s], deltas[s], v.key)
            assert sorted(map(str, again.collect())) == sorted(map(str, v.snapshot.collect())), s
    assert seen[0] is None and len(seen) == 2
    assert e.apply({}) == {}


def test_a_key_behind_other_columns_keeps_its_place(spark):
    c = Catalog()
    t = c.register("pair", spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "v long, k long"), ["k"])
    e, schema = Engine(spark, c), ch.change_schema(t)
    v = e.view(table("pair").where(gt("v", 10)))
    e.apply({"pair": spark.createDataFrame([(0, "edit", (20, 2), (21, 2))], schema)})
    e.apply({"pair": spark.createDataFrame([(0, "edit", (30, 3), (31, 3)), (1, "add", None, (40, 4)), (0, "remove", (10, 1), None)], schema)})
    assert e.catalog["pair"].columns == ["v", "k"]
    assert sorted(map(tuple, e.catalog["pair"].df.collect())) == sorted(map(tuple, v.data().collect())) == [(21, 2), (31, 3), (40, 4)]
    swapped = "seq long, op string, old struct<k:long,v:long>, new struct<k:long,v:long>"
    out = e.apply({"pair": spark.createDataFrame([(0, "edit", (3, 31), (3, 32))], swapped)})
    assert [(r.old.v, r.new.v, r.new.k) for d in out.values() for r in d.collect()] == [(31, 32, 3)]


def test_guard_skips_a_view(spark):
    e = Engine(spark, store(spark))
    v = e.view(table("artist").where("country", "xx"))
    a = e.catalog["artist"]
    assert e.apply({"artist": ch.removes(a, a.df.where("id = 1"))}) == {}
    assert v.data().count() == 0


def test_invalid_batches_change_nothing(spark):
    e = Engine(spark, store(spark))
    v = e.view(table("artist").count())
    a = e.catalog["artist"]
    one = spark.createDataFrame([(1, "again", "de")], SCHEMAS["artist"])
    none = spark.createDataFrame([(77, "none", "de")], SCHEMAS["artist"])
    for bad in (ch.adds(a, one), ch.removes(a, none), ch.edits(a, none, none), ch.adds(a, none).unionByName(ch.adds(a, none, seq=1))):
        with pytest.raises(ConsistencyViolation):
            e.apply({"artist": bad})
    assert v.data().head()[0] == 5
    with pytest.raises(SchemaViolation):
        checked(one.drop("name"), a.df.schema, "artist")


def test_one_batch_may_change_a_row_often(spark):
    e = Engine(spark, store(spark))
    v = e.view(table("artist").count().group_by("country"))
    a = e.catalog["artist"]
    x = spark.createDataFrame([(9, "x", "de")], SCHEMAS["artist"])
    y = spark.createDataFrame([(9, "y", "fr")], SCHEMAS["artist"])
    e.apply({"artist": ch.adds(a, x, 0).unionByName(ch.edits(a, x, y, 1)).unionByName(ch.removes(a, a.df.where("id = 1"), 2))}, batch_id=4)
    assert {r[0]: r[1] for r in v.data().collect()} == {"de": 1, "fr": 2, None: 2}
    assert e.apply({"artist": ch.adds(a, x)}, batch_id=4) == {}


def test_transaction(spark):
    e = Engine(spark, store(spark))
    a = e.catalog["artist"]
    tx = e.transaction()
    tx.write("artist", ch.delete(a, a.df.where("id < 3")))
    assert tx.query(table("artist").count()).head()[0] == 3
    assert e.query(table("artist").count()).head()[0] == 5
    tx.rollback()
    assert tx.commit() == {}
    assert e.one(table("artist").order_by("id", "desc")).id == 5
    assert e.one(table("artist").where("id", 99)) is None
    assert e.to_json(table("artist").where("id", 99)) == "[]"


def test_subscription(spark):
    e = Engine(spark, store(spark))
    v = e.view(table("artist").where("country", "de").count_as("n", albums), pinned=True)
    pub = Publisher(v)
    sub = Subscriber(pub.hello(), v.key)
    e.apply(batch_for(e.catalog, spark))
    (epoch, seq, delta), = pub.queue
    assert sub.take(epoch, seq, delta) and not sub.take(epoch, seq, delta)
    assert sorted(map(str, sub.rows.collect())) == sorted(map(str, v.snapshot.collect()))
    with pytest.raises(SequenceGap):
        sub.take(epoch, seq + 2, delta)
    with pytest.raises(SequenceGap):
        sub.take(epoch + 1, 1, delta)
    sub.start(pub.renew())
    assert (sub.epoch, sub.seq) == (1, 0)
    said = narrated(delta, {"add": "{new.name} came", "remove": "{old.name} left", "edit": "{old.name} from {old.country}"})
    assert {r.text for r in said.collect()} >= {"eve came"}
    e.drop(v.name)
    assert v.name in e.views and v.status == "complete"


def test_engine_extras(spark):
    e = Engine(spark, store(spark))
    assert e.analyze(table("artist").where_exists(albums)) == {"rows": 3, "album": 5, "artist": 3}
    assert "Physical Plan" in e.explain(table("artist").limit(1))
    one, two = (table("artist").count_as(a, albums).query.related[0] for a in ("x", "y"))
    assert aggregate_name(one) == aggregate_name(two)
    assert spark.sql("select timestamp'1970-01-01 00:00:01.5' as t").select(epoch_ms("t")).head()[0] == 1500
    forked = e.fork()
    a = forked.catalog["artist"]
    forked.apply({"artist": ch.removes(a, a.df.where("id = 1"))})
    assert e.query(table("artist").count()).head()[0] == 5 and forked.query(table("artist").count()).head()[0] == 4


def test_deadline_leaves_everything(spark):
    e = Engine(spark, store(spark))
    v = e.view(table("artist").count())
    a = e.catalog["artist"]
    with pytest.raises(DeadlineExceeded):
        e.apply({"artist": ch.removes(a, a.df.where("id = 1"))}, deadline=0.0)
    assert v.status == "error" and v.data().head()[0] == 5 and e.query(table("artist").count()).head()[0] == 5


def test_compaction(spark):
    e = Engine(spark, store(spark), compact_every=2)
    v = e.view(table("artist").where(gt("id", 0)))
    for i in range(5):
        t = e.catalog["artist"]
        e.apply({"artist": ch.adds(t, spark.createDataFrame([(50 + i, "n", None)], SCHEMAS["artist"]))})
    assert v.data().count() == 10 and e.query(table("artist").count()).head()[0] == 10


def test_advice(spark):
    q = table("artist").where("country", "de").order_by("name").limit(2).sub("albums", albums).build()
    found = {a.table: a for a in advise_layout(store(spark), q)}
    assert found["artist"].sort_by == ("country", "name", "id") and found["album"].bucket_by == ("artist",)
    assert "CLUSTERED BY (artist)" in found["album"].sql()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "artist")
    store(spark)["artist"].df.write.parquet(path)
    c = Catalog()
    c.register("artist", spark.read.parquet(path), ["id"])
    df = Lowering(c).lower(table("artist").where("country", "de").where(gt("id", 2)).select("name").build())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country,de)" in plan and "GreaterThan(id,2)" in plan


def test_limited_view_takes_refills_and_leaves(spark):
    e = Engine(spark)
    t = e.register("t", spark.createDataFrame([(i, float(i % 7), i % 3) for i in range(60)], "id long, x double, g long"), ["id"])
    e.register("c", spark.createDataFrame([(i, i % 60) for i in range(150)], "cid long, t long"), ["cid"])
    v = e.view(table("t").where("g", 1).order_by("x", "desc").limit(6).count_as("n", lambda p: table("c").where("t", p.id)))
    rows = lambda df: sorted(map(repr, df.collect()))
    batches = [
        {"t": ch.adds(t, spark.createDataFrame([(100, 99.0, 1), (101, -5.0, 1), (102, None, 1)], "id long, x double, g long"))},
        {"c": ch.adds(e.catalog["c"], spark.createDataFrame([(900, 100), (901, 4)], "cid long, t long"))},
        {"t": ch.removes(t, spark.createDataFrame([(100, 99.0, 1)], "id long, x double, g long"))},
        {"t": ch.edits(t, t.df.where("id = 13"), t.df.where("id = 13").withColumn("x", F.lit(50.0)))},
    ]
    whole = []
    for b in batches:
        before = v.snapshot
        delta = next(iter(e.apply(b).values()))
        assert rows(v.data()) == rows(e.query(v.query))
        assert rows(ch.replayed(before, delta, ["id"])) == rows(v.snapshot)
        whole.append(e.counters["views_whole"])
    assert whole == [0, 0, 1, 1]  # only the row that left a full page asks for the query whole
    told = {r.name: r.value for r in e.metrics().collect()}
    assert told["batches"] == 4 and told["rows_changed.t"] == 5 and told["views_by_touched_rows"] == 3


def test_children_are_cut_to_the_page_before_the_window(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 100 as parent", "id as x").write.parquet(str(tmp_path / "c.parquet"))
    spark.range(100).write.parquet(str(tmp_path / "p.parquet"))
    e = Engine(spark)
    e.register("p", spark.read.parquet(str(tmp_path / "p.parquet")), ["id"])
    e.register("c", spark.read.parquet(str(tmp_path / "c.parquet")), ["id"])
    plan = e.query(table("p").order_by("id").limit(5).sub("c", lambda p: table("c").where("parent", p.id).limit(2)))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window ") :]
    assert "LeftSemi" in below and "rightHint=(strategy=broadcast)" in below
    bound = e.query(table("p").where("id", 7).sub("c", lambda p: table("c").where("parent", p.id)))
    assert "PushedFilters: [IsNotNull(parent), EqualTo(parent,7)]" in bound._jdf.queryExecution().toString()
    assert len(bound.head()["c"]) == 10


def test_deadline_cancels_a_running_job(spark):
    e = Engine(spark)
    t = e.register("t", spark.range(10).toDF("id"), ["id"])
    v = e.view(table("t"))
    slow = spark.range(100, 108, 1, 8).select(F.udf(lambda x: __import__("time").sleep(6) or x, "long")("id").alias("id"))
    began = time.monotonic()
    with pytest.raises(DeadlineExceeded):
        e.apply({"t": ch.adds(t, slow)}, deadline=3)
    assert time.monotonic() - began < 11 and v.data().count() == 10
    assert e.apply({"t": ch.adds(t, spark.range(50, 51).toDF("id"))}, deadline=600) and v.data().count() == 11


def test_snapshot_in_chunks_and_catching_up(spark):
    e = Engine(spark, store(spark))
    v = e.view(table("track").where(gt("ms", 0)))
    pub = Publisher(v, keep=2)
    hello = pub.hello(chunk_rows=2)
    t = e.catalog["track"]
    deltas = []
    for i in range(3):
        e.apply({"track": ch.adds(t, spark.createDataFrame([(200 + i, 10, 1, 1.0)], SCHEMAS["track"]))})
        deltas.append(pub.queue[-1])
    sub = Subscriber(hello, v.key)
    assert len(hello["chunks"]) == 3
    with pytest.raises(SequenceGap):
        sub.take(*deltas[0])
    for i, rows in enumerate(hello["chunks"]):
        assert sub.chunk(0, i, rows) and not sub.chunk(0, i, rows)
    assert sub.rows.count() == 6
    sub.take(*deltas[0])
    for x in pub.since(sub.epoch, sub.seq):
        assert sub.take(*x)
    assert sorted(map(str, sub.rows.collect())) == sorted(map(str, v.snapshot.collect()))
    assert len(pub.queue) == 2 and pub.since(0, 3) == []
    for place in ((0, 0), (1, 3), (0, 4)):
        with pytest.raises(SequenceGap):
            pub.since(*place)
    with pytest.raises(SequenceGap):
        sub.chunk(7, 0, hello["chunks"][0])


def test_idle_views_expire(spark):
    e = Engine(spark, store(spark))
    first, second = (e.view(table("artist").where("country", c), idle=i) for c, i in (("de", 60), ("fr", 0)))
    e.drop(second.name)
    third = e.view(table("artist"))
    assert third.name != first.name and set(e.views) == {first.name, third.name}
    e.drop(first.name)
    assert e.expire(first.left + 59) == [] and e.view(first.query, first.name) is first
    assert e.expire(1e18) == []
    e.drop(first.name)
    assert e.expire(first.left + 60) == [first.name] and set(e.views) == {third.name}


def test_rows_held_by_views(spark):
    e = Engine(spark, store(spark))
    assert e.held().count() == 0
    e.view(table("artist").where("country", "de").select("name").sub("albums", albums))
    e.view(table("artist").where_exists(albums).select("country"), "gated")
    found = {(r["table"], r["key"]): (r["n"], r["present"]) for r in e.held().collect()}
    assert found[("artist", '{"id":1}')] == (2, ["country", "id", "name"])
    assert found[("artist", '{"id":4}')] == (1, ["id", "name"])
    assert found[("artist", '{"id":2}')] == (1, ["country", "id"])
    assert found[("album", '{"id":10}')] == (2, ["artist", "id", "title", "year"])
    assert found[("album", '{"id":12}')] == (1, ["artist", "id"])
    assert ("album", '{"id":14}') not in found
    before = e.held()
    assert {(r.key, r.n) for r in e.footprint(table("artist").where("id", 1).count()).collect()} == {('{"id":1}', 1)}
    e.drop("gated")
    assert {r["key"] for r in before.join(e.held(), ["table", "key"], "left_anti").where("table = 'artist'").collect()} == {'{"id":2}', '{"id":3}'}


def test_text_in_chunks_and_spliced(spark):
    rows = [("a", i, 100 * i, x) for i, x in enumerate(["ab", "cde", None, "", "fé\U0001f600", "h"])] + [("b", 0, 0, "x"), ("b", 1, 900, "y"), ("b", 2, 950, "z"), ("c", 0, 0, None)]
    deltas = spark.createDataFrame(rows, "id string, seq long, at_ms long, text string")
    chunks = chunked_text(deltas, ["id"], chars=4)
    assert sorted(map(tuple, chunks.collect())) == [("a", 0, "abcde"), ("a", 5, "fé\U0001f600h"), ("b", 0, "xy"), ("b", 2, "z")]
    whole = assembled_text(chunks, ["id"])
    assert {r.id: r.text for r in whole.collect()} == {"a": "abcdefé\U0001f600h", "b": "xyz"}
    stored = spark.createDataFrame([("a", "abc"), ("b", "xyzuv"), ("d", None)], "id string, text string")
    assert {r.id: r.text for r in spliced_text(stored, whole.unionByName(whole.where("id = 'a'")), ["id"]).collect()} == {"a": "abcdefé\U0001f600h", "b": "xyzuv", "d": ""}
    assert chunked_text(deltas.limit(0), ["id"]).count() == 0
