"""Registered tables: a DataFrame with its key, other unique keys and default order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import Invalid, SchemaViolation, UnknownColumn, UnknownTable
from millrace.plans.builder import RESERVED


@dataclass(frozen=True)
class TableDef:
    """A base table.  Its key is mandatory, so that every order can be made total."""

    name: str
    df: DataFrame
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    order: tuple[tuple[str, str], ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def kind(self, column: str) -> T.DataType:
        for f in self.df.schema.fields:
            if f.name == column:
                return f.dataType
        raise UnknownColumn(f"{self.name} has no column {column!r}")

    def with_rows(self, df: DataFrame) -> TableDef:
        return replace(self, df=df)

    def get(self, **key: object) -> DataFrame:
        """The row of a key, as a frame of at most one row."""
        if set(key) != set(self.key):
            raise Invalid(f"{self.name} is keyed by {', '.join(self.key)}")
        df = self.df
        for c, v in key.items():
            df = df.where(F.col(f"`{c}`") == F.lit(v))
        return df.limit(1)


@dataclass
class Catalog:
    """The tables that queries may name."""

    tables: dict[str, TableDef] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, key: list[str] | tuple[str, ...], unique: tuple[tuple[str, ...], ...] = (), order: tuple[tuple[str, str], ...] = ()) -> TableDef:
        """Add or replace a table."""
        if name.startswith(RESERVED):
            raise Invalid(f"table names may not start with {' or '.join(RESERVED)}")
        if not key:
            raise Invalid(f"{name} needs a key")
        made = TableDef(name, df, tuple(key), tuple(tuple(u) for u in unique), tuple(order))
        for c in (*made.key, *(c for u in made.unique for c in u), *(c for c, _ in made.order)):
            made.kind(c)
        self.tables[name] = made
        return made

    def __getitem__(self, name: str) -> TableDef:
        if name not in self.tables:
            raise UnknownTable(f"no table {name!r}")
        return self.tables[name]

    def replaced(self, rows: dict[str, DataFrame]) -> Catalog:
        """A catalog with other rows; this one keeps its own (frames don't change)."""
        return Catalog({n: t.with_rows(rows[n]) if n in rows else t for n, t in self.tables.items()})


def from_parquet(spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]]) -> Catalog:
    """A catalog of the parquet tables of a folder."""
    made = Catalog()
    for name, key in keys.items():
        made.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), key)
    return made


#: Whole numbers by width, and how many digits each can have.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def widens(a: T.DataType, b: T.DataType) -> bool:
    """Whether every value of type ``a`` is one of type ``b``."""
    if type(a) is T.DecimalType and type(b) is T.DecimalType:
        return b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
    if type(a) is type(b) or isinstance(a, T.NullType):
        return True
    if type(a) in _DIGITS and isinstance(b, T.DecimalType):
        return b.precision - b.scale >= _DIGITS[type(a)]
    if type(a) in _DIGITS and type(b) in _DIGITS:
        return _DIGITS[type(a)] < _DIGITS[type(b)]
    return isinstance(b, T.DoubleType) and isinstance(a, (T.FloatType, T.ByteType, T.ShortType, T.IntegerType)) or isinstance(b, T.FloatType) and isinstance(a, (T.ByteType, T.ShortType))


def checked(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """``df`` in the columns and types of ``schema``; other columns are refused, and types that could lose a value."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    if set(have) != set(want):
        raise SchemaViolation(f"{name}: columns {sorted(have)} are not {sorted(want)}")
    for c, t in want.items():
        if not widens(have[c], t):
            raise SchemaViolation(f"{name}.{c}: {have[c].simpleString()} is not {t.simpleString()}")
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in want.items()))
