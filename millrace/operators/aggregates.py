"""count, sum and avg, over all rows, groups or a parent's children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import Invalid
from millrace.functions.predicates import kind_of
from millrace.plans.ast import Aggregate
from millrace.sources.catalog import TableDef

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def exact(t: T.DataType) -> bool:
    """Whether sums of this type have one value, in whatever order they are made."""
    return isinstance(t, (*_INTEGRAL, T.DecimalType)) or kind_of(t) != "number"


def whole_sum(total: Column) -> Column:
    """A wide integer total as 64 bits; the query fails where it doesn't fit."""
    fits = total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return F.when(total.isNull() | fits, total.cast("long")).otherwise(F.raise_error(F.lit("SUM_OVERFLOW: an integer sum exceeds 64 bits")).cast("long"))


def summed(a: Aggregate, table: TableDef) -> list[tuple[str, Column]]:
    """The accumulators of an aggregate: they merge by adding."""
    if a.kind == "count":
        return [("n", F.count(F.lit(1)))]
    col, t = F.col(f"`{a.column}`"), table.kind(a.column)
    if kind_of(t) != "number":
        value = F.when(col.isNotNull(), F.lit(0).cast("decimal(19,0)"))
    elif isinstance(t, _INTEGRAL):
        value = col.cast("decimal(19,0)")
    else:
        value = col if isinstance(t, T.DecimalType) else col.cast("double")
    return [("total", F.sum(value)), ("some", F.count(col))]


def finished(a: Aggregate, table: TableDef, at: str = "") -> Column:
    """The aggregate's value from its accumulators ``{at}n`` or ``{at}total`` and ``{at}some``."""
    if a.kind == "count":
        return F.col(f"`{at}n`")
    t = table.kind(a.column)
    total, some = F.col(f"`{at}total`"), F.col(f"`{at}some`")
    if a.kind == "avg":
        return F.when(some > 0, total.cast("double") / some)
    value = total if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else whole_sum(total.cast("decimal(38,0)"))
    return F.when(some > 0, value)


def checked(a: Aggregate, table: TableDef) -> Aggregate:
    if a.kind not in ("count", "sum", "avg"):
        raise Invalid(f"unknown aggregate {a.kind!r}")
    if (a.kind == "count") != (a.column is None):
        raise Invalid(f"{a.kind} takes {'no' if a.kind == 'count' else 'a'} column")
    if a.column is not None:
        table.kind(a.column)
    return a


def accumulated(df: DataFrame, a: Aggregate, table: TableDef, by: list[str]) -> DataFrame:
    """One row of accumulators for each group (or one in all)."""
    sums = [c.alias(f"__{n}") for n, c in summed(checked(a, table), table)]
    return df.groupBy(*(F.col(f"`{c}`") for c in by)).agg(*sums) if by else df.agg(*sums)


def aggregated(df: DataFrame, a: Aggregate, table: TableDef, by: list[str]) -> DataFrame:
    """``[by..., count | sum | avg]``."""
    return accumulated(df, a, table, by).select(*(F.col(f"`{c}`") for c in by), finished(a, table, "__").alias(a.kind))
