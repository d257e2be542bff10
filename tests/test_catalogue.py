"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os
from numbers import Real

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, Real) and math.isnan(v):
        return None
    return float(v) if isinstance(v, Real) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, sql, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(sql.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize(("name", "key", "roots"), [("j_nested2", "c_custkey", "customer"), ("j_m2m", "p_partkey", "part")])
def test_nesting_reaches_every_root(spark, name, key, roots):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = QUERIES[name](spark, folder).select(key).distinct()
    assert got.count() == spark.read.parquet(f"{folder}/{roots}.parquet").count()


#: Queries that copy rows to keys 1,000,000 further on.
COPYING = ["s_diff", "t_stream_view", "t_stream_group", "v_filter", "v_global_count", "v_metrics", "v_gate_flip", "v_group_birth_death", "v_group_double", "v_topn_refill", "v_or_collapse", "v_replay", "v_not_gate", "v_group_sum", "v_nested_child", "v_flat_replay"]


@pytest.fixture(scope="module")
def taken(tmp_path_factory):
    """The smallest tables with every order and item there once more, 1,000,000 keys further on, and SQL over them."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c, folder = duckdb.connect(), str(tmp_path_factory.mktemp("taken"))
    for f in os.listdir(FOLDER):
        key = {"orders.parquet": "o_orderkey", "lineitem.parquet": "l_orderkey"}.get(f)
        rows = f"select * from read_parquet('{FOLDER}/{f}')"
        c.execute(f"copy ({rows + (f' union all select * replace ({key} + 1000000 as {key}) from ({rows})' if key else '')}) to '{folder}/{f}' (format parquet)")
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return folder, c


@pytest.mark.parametrize("name", COPYING)
def test_copies_at_keys_that_are_taken(spark, taken, name):
    folder, sql = taken
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(sql.execute(ORACLE_SQL[name]).fetchdf())
