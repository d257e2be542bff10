"""Total orders, keyset starts and limits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import Invalid, UnknownColumn
from millrace.functions.predicates import predicate
from millrace.plans.ast import Query
from millrace.sources.catalog import TableDef


def completed(order: tuple[tuple[str, str], ...], table: TableDef) -> list[tuple[str, str]]:
    """The order with the missing key columns, ascending, at its end: so it is total."""
    out: list[tuple[str, str]] = []
    for c, way in order or table.order:
        if way not in ("asc", "desc"):
            raise Invalid(f"order is asc or desc, not {way!r}")
        table.kind(c)
        if c not in (x for x, _ in out):
            out.append((c, way))
    return out + [(c, "asc") for c in table.key if c not in (x for x, _ in out)]


def sort_columns(order: list[tuple[str, str]]) -> list[Column]:
    """Sort expressions with null below everything."""
    return [F.col(f"`{c}`").asc_nulls_first() if way == "asc" else F.col(f"`{c}`").desc_nulls_last() for c, way in order]


def _beyond(col: Column, t, way: str, v: Any) -> Column:
    """Strictly after ``v`` in this column's order."""
    if way == "asc":
        return col.isNotNull() if v is None else predicate(col, t, ">", v)
    return F.lit(False) if v is None else predicate(col, t, "<", v) | col.isNull()


def from_start(df: DataFrame, q: Query, table: TableDef) -> DataFrame:
    """The rows at or after the start, in the completed order.

    A sort column that the start doesn't mention counts as null there, so with a
    key left out even an exclusive start keeps the rows that tie with it.
    """
    if q.start is None:
        return df
    row = dict(q.start.row)
    order = completed(q.order_by, table)
    for c in row:
        if c not in table.columns:
            raise UnknownColumn(f"{table.name} has no column {c!r}")
    kept, tied = F.lit(False), F.lit(True)
    for c, way in order:
        col, t, v = F.col(f"`{c}`"), table.kind(c), row.get(c)
        kept = kept | (tied & _beyond(col, t, way, v))
        tied = tied & predicate(col, t, "IS", v)
    return df.where(kept if q.start.exclusive else kept | tied)


def after_texts(row: dict[str, str | None], order: list[tuple[str, str]], table: TableDef) -> Column:
    """Whether a row comes after one whose sort columns are given as text, in the order that sorting has."""
    beyond, tied = F.lit(False), F.lit(True)
    for c, way in order:
        col = F.col(f"`{c}`")
        if row[c] is None:
            more, same = col.isNotNull() if way == "asc" else F.lit(False), col.isNull()
        else:
            v = F.lit(row[c]).cast(table.kind(c))
            more = F.coalesce(col > v, F.lit(False)) if way == "asc" else F.coalesce(col < v, F.lit(True))
            same = F.coalesce(col == v, F.lit(False))
        beyond, tied = beyond | (tied & more), tied & same
    return beyond


def first_rows(df: DataFrame, q: Query, table: TableDef) -> DataFrame:
    """The root's limit: the first rows of the whole order."""
    if q.limit is None:
        return df
    if q.limit == 0:
        return df.where(F.lit(False))
    return df.orderBy(*sort_columns(completed(q.order_by, table))).limit(q.limit)


def ranked(df: DataFrame, order: list[tuple[str, str]], by: list[str], rank: str, limit: int | None = None) -> DataFrame:
    """Rows numbered within each ``by``, only the first ``limit`` where there is one."""
    w = Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy(*sort_columns(order))
    df = df.withColumn(rank, F.row_number().over(w))
    return df if limit is None else df.where(F.col(rank) <= limit)
