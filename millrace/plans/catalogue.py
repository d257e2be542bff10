"""Registered queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import changes as ch
from millrace.operators.flat import flat_changes, levels
from millrace.plans.ast import from_json, to_json
from millrace.plans.builder import (
    Builder, all_of, any_of, compare, define_query, eq, exists, folded, fragment, ge, gt, ilike, in_list, is_, is_not, is_not_null, is_null, le, like, lt, ne, not_exists, not_ilike, not_in_list, not_like, rel, table,
)
from millrace.plans.lower import Lowering
from millrace.sources.catalog import Catalog, from_parquet
from millrace.streaming.driver import Optimistic, assembled_text, chunked_text, follow, grouped_counts, spliced_text
from millrace.streaming.views import Engine

#: Keys of the test tables; lineitem has none but its whole row.
KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test tables, and orders with a nullable priority."""
    made = from_parquet(spark, sf_dir, KEYS)
    orders = made["orders"].df
    made.register("orders_n", orders.withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')")).withColumn("o_custkey", F.expr("nullif(o_custkey % 50, 7)")), ("o_orderkey",))
    return made


def catalog_of_copies(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test tables, where copies of orders and items are rows beside those there, whatever their keys.

    Copies are made at keys 1,000,000 further on, where a larger table has rows of
    its own.  The SQL keeps both, so ``copy`` (0 for the table's rows, 1 for copies)
    is part of what identifies a row.
    """
    made = catalog(spark, sf_dir)
    for name in ("orders", "lineitem"):
        t = made[name]
        made.register(name, t.df.withColumn("copy", F.lit(0)), (*t.key, "copy"))
    return made


def _copies(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({key: F.col(key) + 1_000_000, "copy": F.lit(1)})


#: The SQL of orders_n.
ORDERS_N = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority, nullif(o_custkey % 50, 7) AS o_custkey) FROM orders)"


def _query(name: str, q: Callable[[], Builder], sql: str, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return after(Lowering(catalog(spark, sf_dir)).lower(from_json(to_json(q().build()))))

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _rounded(*names: str, digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, digits) for n in names})


# --- predicates -----------------------------------------------------------------------

_ok = ("o_orderkey", "o_custkey")


def _orders(*conditions, source: str = "orders") -> Callable[[], Builder]:
    return lambda: table(source).where_all(*conditions).select(*_ok)


def _p(name: str, condition, where: str, source: str = "orders") -> None:
    _query(name, _orders(condition, source=source), f"SELECT o_orderkey, o_custkey FROM {ORDERS_N if source == 'orders_n' else source} WHERE {where}")


_p("p_eq", eq("o_orderstatus", "O"), "o_orderstatus = 'O'")
_p("p_ne", ne("o_orderpriority", "1-URGENT"), "o_orderpriority <> '1-URGENT'", "orders_n")
_p("p_lt", lt("o_totalprice", 1000.5), "o_totalprice < 1000.5")
_p("p_le", le("o_orderkey", 100.7), "o_orderkey <= 100.7")
_p("p_gt", gt("o_orderkey", 9000.2), "o_orderkey > 9000.2")
_p("p_ge", ge("o_totalprice", 200000), "o_totalprice >= 200000")
_p("p_time", ge("o_orderdate", "1998-01-01"), "o_orderdate >= TIMESTAMP '1998-01-01'")
_p("p_is", is_("o_orderpriority", "2-HIGH"), "o_orderpriority = '2-HIGH'", "orders_n")
_p("p_is_not", is_not("o_orderpriority", "2-HIGH"), "o_orderpriority IS DISTINCT FROM '2-HIGH'", "orders_n")
_p("p_is_null", is_null("o_orderpriority"), "o_orderpriority IS NULL", "orders_n")
_p("p_is_not_null", is_not_null("o_orderpriority"), "o_orderpriority IS NOT NULL", "orders_n")
_p("p_null_literal", eq("o_orderpriority", None), "false", "orders_n")
_p("p_in", in_list("o_orderkey", [1, 2, 3, 5.0, 7.5, None, 100]), "o_orderkey IN (1, 2, 3, 5, 100)")
_p("p_in_empty", in_list("o_orderkey", []), "false")
_p("p_not_in", not_in_list("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "orders_n")
_p("p_not_in_null", not_in_list("o_orderpriority", ["1-URGENT", None]), "o_orderpriority <> '1-URGENT'", "orders_n")
_p("p_not_in_empty", not_in_list("o_orderpriority", []), "o_orderpriority IS NOT NULL", "orders_n")
_p("p_cross_type", any_of(eq("o_orderkey", "7"), lt("o_orderkey", "a")), "o_orderkey IS NOT NULL")
_p("p_or_groups", any_of(all_of(eq("o_orderstatus", "F"), lt("o_totalprice", 50000)), all_of(eq("o_orderstatus", "P"), gt("o_totalprice", 400000))), "(o_orderstatus = 'F' AND o_totalprice < 50000) OR (o_orderstatus = 'P' AND o_totalprice > 400000)")
_p("p_nested_and_or", all_of(any_of(eq("o_orderpriority", "1-URGENT"), is_null("o_orderpriority")), any_of(eq("o_orderstatus", "O"), all_of(gt("o_totalprice", 300000), ne("o_orderstatus", "O")))), "(o_orderpriority = '1-URGENT' OR o_orderpriority IS NULL) AND (o_orderstatus = 'O' OR (o_totalprice > 300000 AND o_orderstatus <> 'O'))", "orders_n")
_p("p_literal_fold", all_of(folded(1, "<", 2), any_of(folded("a", "=", "b"), eq("o_orderstatus", "P"))), "o_orderstatus = 'P'")
_p("p_empty_and", all_of(), "true")
_p("p_empty_or", any_of(), "false")

_query("p_like", lambda: table("part").where(like("p_name", "%an%")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_name LIKE '%an%'")
_query("p_like_underscore", lambda: table("part").where(like("p_brand", "Brand#_3")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_3'")
_query("p_like_escape", lambda: table("documents").where(like("text", "%\\%%")).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%\\%%' ESCAPE '\\'")
_query("p_not_like", lambda: table("part").where(not_like("p_name", "%a%")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%a%'")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_query("p_ilike", lambda: table("documents").where(ilike("text", "É%")).select("doc_id"), f"SELECT doc_id FROM documents WHERE translate(text, '{_UP}', '{_LOW}') LIKE 'É%'")
_query("p_not_ilike", lambda: table("documents").where(not_ilike("text", "%THE%")).select("doc_id"), f"SELECT doc_id FROM documents WHERE translate(text, '{_UP}', '{_LOW}') NOT LIKE '%the%'")
_query("p_like_number", lambda: table("part").where(not_like("p_size", "%1%")).where(lt("p_size", 5)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size < 5")

# --- projection, order, paging ------------------------------------------------------------

_query("r_project", lambda: table("customer").where(gt("c_acctbal", 9000)).order_by("c_nationkey").select("c_name", "c_mktsegment"), "SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 9000")
_query("r_all_columns", lambda: table("supplier"), "SELECT * FROM supplier")

_ORD = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY"


def _o(name: str, q: Callable[[Builder], Builder], sql: str) -> None:
    _query(name, lambda: q(table("orders")).select("o_orderkey", "o_orderdate"), sql)


_o("o_order_tiebreak", lambda q: q.order_by("o_orderdate").limit(500), f"{_ORD} o_orderdate NULLS FIRST, o_orderkey LIMIT 500")
_o("o_limit", lambda q: q.limit(17), f"{_ORD} o_orderkey LIMIT 17")
_o("o_limit_zero", lambda q: q.limit(0), f"{_ORD} o_orderkey LIMIT 0")
_o("o_multi_dir", lambda q: q.order_by("o_orderstatus", "desc").order_by("o_totalprice").limit(100), f"{_ORD} o_orderstatus DESC NULLS LAST, o_totalprice NULLS FIRST, o_orderkey LIMIT 100")
_o("o_start_incl", lambda q: q.start_at({"o_orderkey": 100}).limit(50), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50")
_o("o_start_excl", lambda q: q.start_after({"o_orderkey": 100}).limit(50), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
_o("o_start_desc", lambda q: q.order_by("o_totalprice", "desc").start_after({"o_totalprice": 100000.0, "o_orderkey": 5}).limit(50), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice < 100000 OR (o_totalprice = 100000 AND o_orderkey > 5) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
_o("o_start_partial", lambda q: q.order_by("o_orderstatus").start_after({"o_orderstatus": "O"}), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus >= 'O'")
_o("o_start_multi", lambda q: q.order_by("o_orderstatus").order_by("o_orderpriority", "desc").start_at({"o_orderstatus": "O", "o_orderpriority": "3-MEDIUM", "o_orderkey": 50}).limit(200), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus > 'O' OR (o_orderstatus = 'O' AND (o_orderpriority < '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND o_orderkey >= 50))) ORDER BY o_orderstatus NULLS FIRST, o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 200")
_o("o_start_limit_filter", lambda q: q.where("o_orderstatus", "F").start_after({"o_orderkey": 200}).limit(30), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 200 ORDER BY o_orderkey LIMIT 30")
_o("o_one", lambda q: q.order_by("o_totalprice", "desc").one(), f"{_ORD} o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1")
_query("o_start_null", lambda: table("orders_n").order_by("o_orderpriority").start_after({"o_orderpriority": None, "o_orderkey": 1000}).limit(4000).select("o_orderkey"), f"SELECT o_orderkey FROM {ORDERS_N} WHERE o_orderpriority IS NOT NULL OR o_orderkey > 1000 ORDER BY o_orderpriority NULLS FIRST, o_orderkey LIMIT 4000")
_query("o_null_low", lambda: table("orders_n").order_by("o_orderpriority", "desc").limit(13000).select("o_orderkey"), f"SELECT o_orderkey FROM {ORDERS_N} ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 13000")

# --- gates --------------------------------------------------------------------------------

_items = lambda *c: lambda p: table("lineitem").where("l_orderkey", p.o_orderkey).where_all(*c)
_own = lambda *c: lambda p: table("orders").where("o_custkey", p.c_custkey).where_all(*c)
_ITEMS, _OWN = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey", "SELECT 1 FROM orders WHERE o_custkey = c_custkey"


def _e(name: str, q: Callable[[Builder], Builder], where: str, source: str = "orders") -> None:
    key = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "orders_n": "o_orderkey"}[source]
    _query(name, lambda: q(table(source)).select(key), f"SELECT {key} FROM {ORDERS_N if source == 'orders_n' else source} WHERE {where}")


_e("e_exists", lambda q: q.where_exists(_items(gt("l_quantity", 45))), f"EXISTS ({_ITEMS} AND l_quantity > 45)")
_e("e_not_exists", lambda q: q.where_not_exists(_items()), f"NOT EXISTS ({_ITEMS})")
_e("e_null_key", lambda q: q.where_not_exists(lambda p: table("customer").where("c_custkey", p.o_custkey)), "NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)", "orders_n")
_e("e_multi", lambda q: q.where_exists(_own(eq("o_orderstatus", "F"))).where_not_exists(_own(gt("o_totalprice", 400000))).where(gt("c_acctbal", 0)), f"EXISTS ({_OWN} AND o_orderstatus = 'F') AND NOT EXISTS ({_OWN} AND o_totalprice > 400000) AND c_acctbal > 0", "customer")
_e("e_same_table_twice", lambda q: q.where_exists(_items(eq("l_returnflag", "R"))).where_exists(_items(eq("l_returnflag", "A"))), f"EXISTS ({_ITEMS} AND l_returnflag = 'R') AND EXISTS ({_ITEMS} AND l_returnflag = 'A')")
_e("e_or_leaf", lambda q: q.where_any(gt("o_totalprice", 400000), exists(_items(gt("l_discount", 0.095)))), f"o_totalprice > 400000 OR EXISTS ({_ITEMS} AND l_discount > 0.095)")
_e("e_or_mixed", lambda q: q.where_any(not_exists(_items()), exists(_items(gt("l_quantity", 49)), flip=True), eq("o_orderstatus", "P")), f"NOT EXISTS ({_ITEMS}) OR EXISTS ({_ITEMS} AND l_quantity > 49) OR o_orderstatus = 'P'")
_e("e_or_nested", lambda q: q.where_any(all_of(exists(_own(gt("o_totalprice", 450000))), lt("c_acctbal", 5000)), all_of(not_exists(_own(eq("o_orderstatus", "P"))), any_of(eq("c_mktsegment", "BUILDING"), gt("c_acctbal", 9000)))), f"(EXISTS ({_OWN} AND o_totalprice > 450000) AND c_acctbal < 5000) OR (NOT EXISTS ({_OWN} AND o_orderstatus = 'P') AND (c_mktsegment = 'BUILDING' OR c_acctbal > 9000))", "customer")
_e("e_nested_chain", lambda q: q.where_exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where_exists(_items(eq("l_returnflag", "R"), gt("l_quantity", 48)))), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 48))", "customer")
_e("e_not_nested", lambda q: q.where_exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where_not_exists(_items())), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))", "customer")
_e("e_nested_in_or", lambda q: q.where_any(eq("c_nationkey", 3), exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where_not_exists(_items()))), "c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))", "customer")
_e("e_having_count", lambda q: q.count_as("n", _items(gt("l_quantity", 20))).having_count("n", ">", 3), "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) > 3")
ORACLE_SQL["e_having_count"] = "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) AS n FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) > 3"
_e("e_limit_zero", lambda q: q.where_any(exists(lambda p: table("lineitem").where("l_orderkey", p.o_orderkey).limit(0)), eq("o_orderstatus", "F")).where_not_exists(lambda p: table("lineitem").where("l_orderkey", p.o_orderkey).limit(0)), "o_orderstatus = 'F'")
_e("e_child_limit", lambda q: q.where_exists(lambda p: table("lineitem").where("l_orderkey", p.o_orderkey).order_by("l_quantity").limit(1)), f"EXISTS ({_ITEMS})")
_e("e_scalar", lambda q: q.where_exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where("o_orderkey", 7), scalar=True), f"EXISTS ({_OWN} AND o_orderkey = 7)", "customer")
_e("e_scalar_not", lambda q: q.where_not_exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where("o_orderkey", 7), scalar=True), f"NOT EXISTS ({_OWN} AND o_orderkey = 7)", "customer")
_e("e_scalar_missing", lambda q: q.where_not_exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where("o_orderkey", -1), scalar=True), "true", "customer")
_e("e_flipped", lambda q: q.where_exists(_items(eq("l_linestatus", "O")), flip=True), f"EXISTS ({_ITEMS} AND l_linestatus = 'O')")
_e("e_permission", lambda q: q.where_exists_no_sync(lambda p: table("labels").where("doc_id", p.doc_id)).where_not_exists_no_sync(lambda p: table("labels").where("doc_id", p.doc_id).where("toxic", 1)), "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 1)", "documents")
_query("e_relationship", lambda: table("nation").where_exists(rel("nation", "supplier", {"n_nationkey": "s_nationkey"}), lambda b: b.where(gt("s_acctbal", 9000))).select("n_name"), "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")

# --- aggregates ---------------------------------------------------------------------------

_query("g_count", lambda: table("lineitem").where(gt("l_quantity", 25)).count(), "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25")
_query("g_sum_int", lambda: table("orders").sum("o_custkey"), "SELECT CAST(sum(o_custkey) AS BIGINT) AS sum FROM orders")
_query("g_sum_double", lambda: table("orders").sum("o_totalprice"), "SELECT round(sum(o_totalprice), 2) AS sum FROM orders", _rounded("sum"))
_query("g_sum_text", lambda: table("orders").sum("o_orderstatus"), "SELECT CAST(0 AS BIGINT) AS sum")
_query("g_avg", lambda: table("part").avg("p_size"), "SELECT round(avg(p_size), 2) AS avg FROM part", _rounded("avg"))
_query("g_empty", lambda: table("orders").where(lt("o_orderkey", -5)).sum("o_custkey"), "SELECT CAST(NULL AS BIGINT) AS sum")
_query("g_empty_count", lambda: table("orders").where(lt("o_orderkey", -5)).count(), "SELECT CAST(0 AS BIGINT) AS count")
_query("g_group1", lambda: table("orders").count().group_by("o_orderstatus"), "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus")
_query("g_group2", lambda: table("lineitem").sum("l_linenumber").group_by("l_returnflag", "l_linestatus"), "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS sum FROM lineitem GROUP BY ALL")
_query("g_group_avg", lambda: table("events").avg("value").group_by("event_type"), "SELECT event_type, round(avg(value), 2) AS avg FROM events GROUP BY event_type", _rounded("avg"))
_query("g_having", lambda: table("orders").count().group_by("o_custkey").having(gt("count", 12)), "SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_query("g_having_or", lambda: table("orders").count().group_by("o_custkey").having(any_of(gt("count", 15), lt("o_custkey", 10))), "SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 15 OR o_custkey < 10")
_query("g_group_null", lambda: table("orders_n").count().group_by("o_orderpriority"), f"SELECT o_orderpriority, count(*) AS count FROM {ORDERS_N} GROUP BY o_orderpriority")
_query("g_rel_count", lambda: table("orders").count_as("n", _items()).select("o_orderkey"), "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
_query("g_rel_sum", lambda: table("orders").sum_as("n", "l_linenumber", _items()).select("o_orderkey"), "SELECT o_orderkey, (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
_query("g_rel_avg", lambda: table("customer").avg_as("n", "o_totalprice", _own()).select("c_custkey"), "SELECT c_custkey, (SELECT round(avg(o_totalprice), 6) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", _rounded("n", digits=6))
_query("g_rel_count_filtered", lambda: table("customer").count_as("n", lambda p: table("orders").where("o_custkey", p.c_custkey).where_not_exists(_items())).select("c_custkey"), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS n FROM customer")


def _precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    made = Lowering(c).lower(table("lineitem").count().group_by("l_orderkey").build())
    c.register("item_counts", made, ("l_orderkey",))
    q = table("orders").count_as("n", lambda p: table("item_counts").where("l_orderkey", p.o_orderkey), precomputed=True).select("o_orderkey")
    return Lowering(c).lower(q.build())


QUERIES["g_rel_precomputed"], ORACLE_SQL["g_rel_precomputed"] = _precomputed, ORACLE_SQL["g_rel_count"]

# --- nesting ------------------------------------------------------------------------------


def _exploded(alias: str, *columns: str, keep: tuple[str, ...], pos: bool = True):
    def after(df: DataFrame) -> DataFrame:
        out = df.select(*keep, F.posexplode_outer(alias).alias("pos", "v"))
        return out.select(*keep, *(["pos"] if pos else []), *(F.col(f"v.{c}").alias(c) for c in columns))

    return after


_TOP = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders"
_query("j_related", lambda: table("customer").sub("orders", _own()).select("c_custkey"), "SELECT c_custkey, CAST(pos AS INTEGER) AS pos, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) o ON o_custkey = c_custkey", _exploded("orders", "o_orderkey", keep=("c_custkey",)))
_query("j_child_limit", lambda: table("customer").sub("orders", lambda p: table("orders").where("o_custkey", p.c_custkey).order_by("o_totalprice", "desc").limit(3)).select("c_custkey"), f"SELECT c_custkey, CAST(pos AS INTEGER) AS pos, o_orderkey FROM customer LEFT JOIN (SELECT * FROM ({_TOP}) WHERE pos < 3) o ON o_custkey = c_custkey", _exploded("orders", "o_orderkey", keep=("c_custkey",)))
_query("j_child_filter_start", lambda: table("customer").sub("orders", lambda p: table("orders").where("o_custkey", p.c_custkey).where("o_orderstatus", "O").order_by("o_totalprice", "desc").start_after({"o_totalprice": 200000, "o_orderkey": 0}).limit(2)).select("c_custkey"), "SELECT c_custkey, CAST(pos AS INTEGER) AS pos, o_orderkey FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 0))) WHERE pos < 2) o ON o_custkey = c_custkey", _exploded("orders", "o_orderkey", keep=("c_custkey",)))
_query("j_one", lambda: table("customer").sub("best", lambda p: table("orders").where("o_custkey", p.c_custkey).where(gt("o_totalprice", 400000)).order_by("o_totalprice", "desc").one()).select("c_custkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice > 400000) WHERE r = 1) o ON o_custkey = c_custkey", lambda df: df.select("c_custkey", F.col("best.o_orderkey").alias("o_orderkey")))
_query("j_sibling", lambda: table("nation").sub("customers", lambda p: table("customer").where("c_nationkey", p.n_nationkey)).sub("suppliers", lambda p: table("supplier").where("s_nationkey", p.n_nationkey)).select("n_name"), "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation", lambda df: df.select("n_name", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers")))
_query("j_nested2", lambda: table("customer").sub("orders", lambda p: table("orders").where("o_custkey", p.c_custkey).sub("items", _items())).select("c_custkey"), "SELECT c_custkey, o_orderkey, l_partkey, l_linenumber, l_extendedprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey", lambda df: df.select("c_custkey", F.explode_outer("orders").alias("o")).select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.explode_outer("o.items").alias("l")).select("c_custkey", "o_orderkey", "l.l_partkey", "l.l_linenumber", "l.l_extendedprice"))
_query("j_nested3", lambda: table("region").sub("nations", lambda p: table("nation").where("n_regionkey", p.r_regionkey).sub("suppliers", lambda p: table("supplier").where("s_nationkey", p.n_nationkey).sub("items", lambda p: table("lineitem").where("l_suppkey", p.s_suppkey).where(gt("l_quantity", 49))))).select("r_name"), "SELECT r_name, n_name, s_name, l_orderkey, l_linenumber FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) l ON l_suppkey = s_suppkey", lambda df: df.select("r_name", F.explode_outer("nations").alias("n")).select("r_name", F.col("n.n_name").alias("n_name"), F.explode_outer("n.suppliers").alias("s")).select("r_name", "n_name", F.col("s.s_name").alias("s_name"), F.explode_outer("s.items").alias("l")).select("r_name", "n_name", "s_name", "l.l_orderkey", "l.l_linenumber"))
_query("j_compound", lambda: table("conversations").where("role", "user").sub("same", lambda p: table("conversations").where("conv_id", p.conv_id).where("turn", p.turn)).select("conv_id", "turn"), "SELECT conv_id, turn, 1 AS same FROM conversations WHERE role = 'user'", lambda df: df.select("conv_id", "turn", F.size("same").alias("same")))
_query("j_self", lambda: table("customer").sub("peers", lambda p: table("customer").where("c_nationkey", p.c_nationkey).order_by("c_acctbal", "desc").limit(2)).select("c_custkey"), "SELECT c.c_custkey, CAST(pos AS INTEGER) AS pos, p.c_custkey AS peer FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos FROM customer) WHERE pos < 2) p ON p.c_nationkey = c.c_nationkey", lambda df: df.select("c_custkey", F.posexplode_outer("peers").alias("pos", "v")).select("c_custkey", "pos", F.col("v.c_custkey").alias("peer")))
_query("j_m2m", lambda: table("part").sub("items", lambda p: table("lineitem").where("l_partkey", p.p_partkey).sub("supplier", lambda p: table("supplier").where("s_suppkey", p.l_suppkey).one())).select("p_partkey"), "SELECT p_partkey, l_orderkey, l_linenumber, s_name FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey", lambda df: df.select("p_partkey", F.explode_outer("items").alias("l")).select("p_partkey", "l.l_orderkey", "l.l_linenumber", F.col("l.supplier.s_name").alias("s_name")))
_query("j_dup_alias", lambda: table("customer").sub("orders", _own()).sub("orders", _own(eq("o_orderstatus", "P"))).select("c_custkey"), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS orders FROM customer", lambda df: df.select("c_custkey", F.size("orders").cast("long").alias("orders")))
_query("j_shadow", lambda: table("customer").count_as("c_name", _own()), "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS c_name FROM customer")
_query("j_null_key", lambda: table("orders_n").sub("customer", lambda p: table("customer").where("c_custkey", p.o_custkey)).select("o_orderkey"), f"SELECT o_orderkey, c_custkey FROM {ORDERS_N} LEFT JOIN customer ON c_custkey = o_custkey", lambda df: df.select("o_orderkey", F.explode_outer("customer").alias("c")).select("o_orderkey", "c.c_custkey"))

# --- builder extras -------------------------------------------------------------------------


def _fragments() -> Builder:
    names = fragment(table("customer").select("c_name"))
    top = fragment(table("customer").select("c_custkey").count_as("n", _own()))
    return table("customer").where(gt("c_acctbal", 9500)).include(names, top)


_query("a_include", _fragments, "SELECT c_name, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > 9500")
_big = define_query("big_orders", lambda least: table("orders").where(compare("o_totalprice", ">=", least)).select("o_orderkey"), float)
_query("a_named", lambda: Builder(_big("450000")), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 450000")

# --- outputs, differences ---------------------------------------------------------------------


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog(spark, sf_dir))
    text = e.to_json(table("region").order_by("r_name").count_as("nations", lambda p: table("nation").where("n_regionkey", p.r_regionkey)).select("r_name"))
    return spark.createDataFrame([(text,)], "doc string")


QUERIES["n_json"] = _json
ORACLE_SQL["n_json"] = "SELECT '[' || string_agg('{\"r_name\":\"' || r_name || '\",\"nations\":' || n || '}', ',' ORDER BY r_name) || ']' AS doc FROM (SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table("nation").sub("suppliers", lambda p: table("supplier").where("s_nationkey", p.n_nationkey)).build()
    return levels(Lowering(catalog(spark, sf_dir)).lower(q, project=False), ["n_nationkey"]).groupBy("path").count().withColumnRenamed("count", "n")


QUERIES["n_levels"], ORACLE_SQL["n_levels"] = _levels, "SELECT '' AS path, count(*) AS n FROM nation UNION ALL SELECT 'suppliers', count(*) FROM supplier"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog(spark, sf_dir))
    e.view(table("orders").where(gt("o_totalprice", 450000)).select("o_totalprice"))
    e.view(table("customer").where(gt("c_acctbal", 9900)).sub("orders", _own()).select("c_name"))
    return e.held().select("table", F.coalesce(F.get_json_object("key", "$.o_orderkey"), F.get_json_object("key", "$.c_custkey")).cast("long").alias("id"), "n", F.array_join("present", ",").alias("present"))


QUERIES["n_held"] = _held
ORACLE_SQL["n_held"] = "SELECT 'customer' AS \"table\", c_custkey AS id, 1 AS n, 'c_custkey,c_name' AS present FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'orders', o_orderkey, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END, CASE WHEN b THEN (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE orders)) ELSE 'o_orderkey,o_totalprice' END FROM (SELECT o_orderkey, o_totalprice > 450000 AS a, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9900) AS b FROM orders) WHERE a OR b"


def _footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table("orders").where(gt("o_totalprice", 450000)).where_exists(_items(gt("l_quantity", 40))).sub("items", _items(eq("l_returnflag", "R"))).select("o_orderkey")
    return Engine(spark, catalog(spark, sf_dir)).footprint(q).where("table = 'orders'").select(F.get_json_object("key", "$.o_orderkey").cast("long").alias("o_orderkey"), "n")


QUERIES["n_footprint"] = _footprint
ORACLE_SQL["n_footprint"] = f"SELECT o_orderkey, CAST(1 AS BIGINT) AS n FROM orders WHERE o_totalprice > 450000 AND EXISTS ({_ITEMS} AND l_quantity > 40)"


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog_of_copies(spark, sf_dir)["orders"]
    a = t.df
    b = a.where("o_orderkey % 97 != 0").withColumn("o_totalprice", F.expr("if(o_orderkey % 53 = 0, o_totalprice + 1, o_totalprice)")).unionByName(_copies(a.where("o_orderkey % 101 = 0"), "o_orderkey"))
    return ch.difference(a, b, list(t.key)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


QUERIES["s_diff"] = _diff
ORACLE_SQL["s_diff"] = "SELECT 'remove' AS op, count(*) AS n FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'edit', count(*) FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 53 = 0 UNION ALL SELECT 'add', count(*) FROM orders WHERE o_orderkey % 101 = 0"
QUERIES["s_get"] = lambda spark, sf_dir: catalog(spark, sf_dir)["orders"].get(o_orderkey=42)
ORACLE_SQL["s_get"] = "SELECT * FROM orders WHERE o_orderkey = 42"
QUERIES["s_sql"] = lambda spark, sf_dir: Engine(spark, catalog(spark, sf_dir)).sql("SELECT n_name FROM nation WHERE n_regionkey = :r", r=2)
ORACLE_SQL["s_sql"] = "SELECT n_name FROM nation WHERE n_regionkey = 2"

# --- maintained views -------------------------------------------------------------------------

#: The batches, and the tables after them in SQL.
NEW_ORDERS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN o_custkey % 100 + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 100000 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 89 = 0)"
NEW_ITEMS = "(SELECT * FROM lineitem WHERE l_orderkey % 211 <> 0 UNION ALL SELECT * REPLACE (l_orderkey + 1000000 AS l_orderkey) FROM lineitem WHERE l_orderkey % 89 = 0)"


def batch(c: Catalog) -> dict[str, DataFrame]:
    """Removes, value edits, key edits, adds of orders; removes and adds of their items; the tables are those of ``catalog_of_copies``."""
    orders, items = c["orders"], c["lineitem"]
    old = orders.df.where("o_orderkey % 97 != 0 and (o_orderkey % 53 = 0 or o_orderkey % 101 = 0)")
    new = old.withColumns({"o_custkey": F.expr("if(o_orderkey % 101 = 0, o_custkey % 100 + 1, o_custkey)"), "o_totalprice": F.expr("if(o_orderkey % 53 = 0, o_totalprice + 100000, o_totalprice)")})
    return {
        "orders": ch.removes(orders, orders.df.where("o_orderkey % 97 = 0")).unionByName(ch.edits(orders, old, new)).unionByName(ch.adds(orders, _copies(orders.df.where("o_orderkey % 89 = 0"), "o_orderkey"))),
        "lineitem": ch.removes(items, items.df.where("l_orderkey % 211 = 0")).unionByName(ch.adds(items, _copies(items.df.where("l_orderkey % 89 = 0"), "l_orderkey"))),
    }


def _view(name: str, q: Callable[[], Builder], sql: str, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, catalog_of_copies(spark, sf_dir))
        v = e.view(q())
        e.apply(batch(e.catalog))
        return after(v.data())

    QUERIES[name], ORACLE_SQL[name] = run, sql


_view("v_filter", lambda: table("orders").where(gt("o_totalprice", 400000)).select("o_orderkey", "o_custkey"), f"SELECT o_orderkey, o_custkey FROM {NEW_ORDERS} WHERE o_totalprice > 400000")
_view("v_gate_flip", lambda: table("orders").where_exists(_items()).select("o_orderkey"), f"SELECT o_orderkey FROM {NEW_ORDERS} WHERE EXISTS (SELECT 1 FROM {NEW_ITEMS} WHERE l_orderkey = o_orderkey)")
_view("v_not_gate", lambda: table("orders").where_not_exists(_items(gt("l_quantity", 10))).select("o_orderkey"), f"SELECT o_orderkey FROM {NEW_ORDERS} WHERE NOT EXISTS (SELECT 1 FROM {NEW_ITEMS} WHERE l_orderkey = o_orderkey AND l_quantity > 10)")
_view("v_or_collapse", lambda: table("customer").where_any(exists(_own(gt("o_totalprice", 480000))), eq("c_nationkey", 3), not_exists(_own())).select("c_custkey"), f"SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM {NEW_ORDERS} WHERE o_custkey = c_custkey AND o_totalprice > 480000) OR NOT EXISTS (SELECT 1 FROM {NEW_ORDERS} WHERE o_custkey = c_custkey)")
_view("v_topn_refill", lambda: table("orders").order_by("o_totalprice", "desc").limit(40).select("o_orderkey"), f"SELECT o_orderkey FROM {NEW_ORDERS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
_view("v_nested_child", lambda: table("customer").sub("orders", lambda p: table("orders").where("o_custkey", p.c_custkey).order_by("o_totalprice", "desc").limit(2).count_as("n", _items())).select("c_custkey"), f"SELECT c_custkey, CAST(pos AS INTEGER) AS pos, o_orderkey, CASE WHEN o_orderkey IS NOT NULL THEN (SELECT count(*) FROM {NEW_ITEMS} WHERE l_orderkey = o_orderkey) END AS n FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM {NEW_ORDERS}) WHERE pos < 2) o ON o_custkey = c_custkey", _exploded("orders", "o_orderkey", "n", keep=("c_custkey",)))
_view("v_group_birth_death", lambda: table("orders").count().group_by("o_custkey").having(gt("count", 3)), f"SELECT o_custkey, count(*) AS count FROM {NEW_ORDERS} GROUP BY o_custkey HAVING count(*) > 3")
_view("v_group_sum", lambda: table("lineitem").sum("l_linenumber").group_by("l_orderkey"), f"SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS sum FROM {NEW_ITEMS} GROUP BY l_orderkey")
_view("v_group_double", lambda: table("orders").avg("o_totalprice").group_by("o_orderpriority"), f"SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg FROM {NEW_ORDERS} GROUP BY o_orderpriority", _rounded("avg", digits=4))
_view("v_global_count", lambda: table("lineitem").where(gt("l_quantity", 25)).count(), f"SELECT count(*) AS count FROM {NEW_ITEMS} WHERE l_quantity > 25")


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog_of_copies(spark, sf_dir))
    v = e.view(table("orders").where(gt("o_totalprice", 300000)).count_as("n", _items()))
    before = v.snapshot
    delta = next(iter(e.apply(batch(e.catalog)).values()))
    return ch.replayed(before, delta, v.key).select("o_orderkey", F.col("`@n`").alias("n"))


QUERIES["v_replay"] = _replay
ORACLE_SQL["v_replay"] = f"SELECT o_orderkey, (SELECT count(*) FROM {NEW_ITEMS} WHERE l_orderkey = o_orderkey) AS n FROM {NEW_ORDERS} WHERE o_totalprice > 300000"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog_of_copies(spark, sf_dir))
    e.view(table("orders").where_exists(_items()))
    e.view(table("nation"))
    e.apply(batch(e.catalog))
    return e.metrics().where("name != 'apply_ms'")


QUERIES["v_metrics"] = _metrics
ORACLE_SQL["v_metrics"] = "SELECT 'batches' AS name, CAST(1 AS BIGINT) AS value UNION ALL SELECT 'views_by_touched_rows', 1 UNION ALL SELECT 'views_untouched', 1 UNION ALL SELECT 'rows_changed.orders', (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) + (SELECT count(*) FROM orders WHERE o_orderkey % 97 <> 0 AND (o_orderkey % 53 = 0 OR (o_orderkey % 101 = 0 AND o_custkey <> o_custkey % 100 + 1))) + (SELECT count(*) FROM orders WHERE o_orderkey % 89 = 0) UNION ALL SELECT 'rows_changed.lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey % 211 = 0) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 89 = 0)"


def _flat_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog_of_copies(spark, sf_dir))
    v = e.view(table("customer").sub("orders", lambda p: table("orders").where("o_custkey", p.c_custkey).order_by("o_totalprice", "desc").limit(2).sub("items", _items(gt("l_quantity", 30)))))
    before = v.snapshot
    e.apply(batch(e.catalog))
    nodes = ch.replayed(levels(before, v.key), flat_changes(before, v.snapshot, v.key), ["path", "key"])
    return nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("row", "$.o_orderkey").cast("long")).alias("orders"), F.sum(F.get_json_object("row", "$.l_partkey").cast("long")).alias("parts"))


QUERIES["v_flat_replay"] = _flat_replay
_LATER = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {NEW_ORDERS}) WHERE r <= 2)"
ORACLE_SQL["v_flat_replay"] = f"SELECT '' AS path, count(*) AS n, CAST(NULL AS BIGINT) AS orders, CAST(NULL AS BIGINT) AS parts FROM customer UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), NULL FROM {_LATER} JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'orders.items', count(*), NULL, CAST(sum(l_partkey) AS BIGINT) FROM {_LATER} JOIN customer ON c_custkey = o_custkey JOIN {NEW_ITEMS} ON l_orderkey = o_orderkey AND l_quantity > 30"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog(spark, sf_dir))
    v = e.view(table("nation").count().group_by("n_regionkey"))
    t = e.catalog["nation"]
    with e.transaction() as tx:
        tx.write("nation", ch.upsert(t, t.df.where("n_nationkey < 5").withColumn("n_regionkey", F.lit(4)).unionByName(t.df.where("n_nationkey = 3").withColumn("n_nationkey", F.lit(99)))))
        tx.write("nation", ch.delete(t, t.df.where("n_nationkey in (10, 11)")))
    return v.data()


QUERIES["v_keyed_writes"] = _keyed
ORACLE_SQL["v_keyed_writes"] = "SELECT n_regionkey, count(*) AS count FROM (SELECT CASE WHEN n_nationkey < 5 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey NOT IN (10, 11) UNION ALL SELECT n_regionkey FROM nation WHERE n_nationkey = 3) GROUP BY n_regionkey"


def _optimistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog(spark, sf_dir))
    v = e.view(table("orders").where("o_orderstatus", "P").select("o_orderkey", "o_totalprice"))
    o = Optimistic(e)
    bump = lambda c: {"orders": ch.update(c["orders"], c["orders"].df.where("o_orderkey % 53 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))}
    drop = lambda c: {"orders": ch.delete(c["orders"], c["orders"].df.where("o_orderkey % 59 = 0"))}
    o.mutate("bump", bump)
    o.mutate("drop", drop)
    o.confirm({"orders": ch.removes(o.sync["orders"], o.sync["orders"].df.where("o_orderkey % 97 = 0"))}, done=("drop",))
    return v.data()


QUERIES["x_optimistic_rewind"] = _optimistic
ORACLE_SQL["x_optimistic_rewind"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 97 <> 0"


def _stream(q: Callable[[], Builder]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        from millrace.sources.storage import shared_folder

        e = Engine(spark, catalog_of_copies(spark, sf_dir))
        v = e.view(q())
        folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
        batch(e.catalog)["orders"].withColumn("seq", F.pmod(F.xxhash64("op"), F.lit(3))).repartition(3, "op").write.parquet(f"{folder}/in")
        follow(e, "orders", f"{folder}/in", f"{folder}/checkpoint").awaitTermination()
        return v.data()

    return run


QUERIES["t_stream_view"] = _stream(lambda: table("orders").where(gt("o_totalprice", 400000)).select("o_orderkey"))
ORACLE_SQL["t_stream_view"] = f"SELECT o_orderkey FROM {NEW_ORDERS} WHERE o_totalprice > 400000"
QUERIES["t_stream_group"] = _stream(lambda: table("orders").count().group_by("o_custkey"))
ORACLE_SQL["t_stream_group"] = f"SELECT o_custkey, count(*) AS count FROM {NEW_ORDERS} GROUP BY o_custkey"


def _counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from millrace.sources.storage import shared_folder

    folder = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type")
    events.repartition(3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = grouped_counts(source, ["event_type"]).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES["t_grouped_stream"], ORACLE_SQL["t_grouped_stream"] = _counted_stream, "SELECT event_type, count(*) AS count FROM events GROUP BY event_type"


_TURN = ["conv_id", "turn", "role"]


def _deltas(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """The texts of conversations in live pieces, each a tenth of a second after the one before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("length(text) > 0 and role is not null")
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.char_length("text") - 1) / each))
    return turns.select(*_TURN, "text", F.explode(cut).alias("seq")).select(*_TURN, "seq", (F.col("seq") * 100).alias("at_ms"), F.substring("text", (F.col("seq") * each + 1).cast("int"), F.lit(each)).alias("text"))


def _text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_text(_deltas(spark, sf_dir, 7), _TURN, chars=20, interval_ms=10**9)


def _text_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = _deltas(spark, sf_dir, 7)
    early = assembled_text(chunked_text(deltas.where("seq < 5"), _TURN, chars=20), _TURN)
    return spliced_text(early, assembled_text(deltas, _TURN), _TURN)


# pieces of 7 characters reach 20 with the third one
QUERIES["t_text_chunks"] = _text_chunks
ORACLE_SQL["t_text_chunks"] = "SELECT conv_id, turn, role, seq, substr(text, CAST(seq + 1 AS BIGINT), 21) AS text FROM (SELECT conv_id, turn, role, text, unnest(range(0, length(text), 21)) AS seq FROM conversations WHERE length(text) > 0 AND role IS NOT NULL)"
QUERIES["t_text_splice"] = _text_splice
ORACLE_SQL["t_text_splice"] = "SELECT conv_id, turn, role, text FROM conversations WHERE length(text) > 0 AND role IS NOT NULL"


def _text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null and role is not null")
    cut = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / 40))
    pieces = turns.select("conv_id", "turn", "role", "text", F.posexplode(cut).alias("seq", "i")).select("conv_id", "turn", "role", "seq", F.substring("text", (F.col("i") * 40 + 1).cast("int"), F.lit(40)).alias("text"))
    return assembled_text(pieces.unionByName(pieces.where("seq % 2 = 0")), ["conv_id", "turn", "role"])


QUERIES["t_text_stream"], ORACLE_SQL["t_text_stream"] = _text_stream, "SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with items returned, their three dearest orders from a start on, each with its number of items."""
    orders = lambda p: table("orders").where("o_custkey", p.c_custkey).order_by("o_totalprice", "desc").limit(3).count_as("items", _items()).select("o_orderkey", "o_totalprice")
    q = (
        table("customer")
        .where_exists(lambda p: table("orders").where("o_custkey", p.c_custkey).where_exists(_items(eq("l_returnflag", "R"))))
        .sub("orders", orders)
        .order_by("c_acctbal", "desc")
        .start_at({"c_acctbal": 9000.0})
        .limit(50)
        .select("c_custkey", "c_name", "c_acctbal")
    )
    return Lowering(catalog(spark, sf_dir)).lower(q.build())


QUERIES["flagship"] = lambda spark, sf_dir: _exploded("orders", "o_orderkey", "items", keep=("c_custkey",))(flagship(spark, sf_dir))
ORACLE_SQL["flagship"] = f"SELECT c_custkey, CAST(pos AS INTEGER) AS pos, o_orderkey, CASE WHEN o_orderkey IS NOT NULL THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS items FROM (SELECT * FROM customer WHERE c_acctbal <= 9000 AND EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R') ORDER BY c_acctbal DESC, c_custkey LIMIT 50) LEFT JOIN (SELECT * FROM ({_TOP}) WHERE pos < 3) o ON o_custkey = c_custkey"
