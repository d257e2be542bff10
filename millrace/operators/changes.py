"""Batches of row changes: their net effect, checks, and what differs between two states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConsistencyViolation, SchemaViolation
from millrace.sources.catalog import TableDef, checked
from millrace.plans.keys import FEW, few
from millrace.sources.storage import stored


def change_schema(table: TableDef) -> T.StructType:
    """``seq, op (add, remove, edit), old, new`` for a table; ``old`` and ``new`` are whole rows."""
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.df.schema.fields])
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("old", row), T.StructField("new", row)])


def _rows(table: TableDef, df: DataFrame, seq: int, op: str, old: bool, new: bool) -> DataFrame:
    schema = change_schema(table)
    df = checked(df, table.df.schema, table.name)
    row = F.struct(*(F.col(f"`{c}`") for c in table.columns))
    return df.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), (row if old else F.lit(None)).cast(schema["old"].dataType).alias("old"), (row if new else F.lit(None)).cast(schema["new"].dataType).alias("new"))


def adds(table: TableDef, rows: DataFrame, seq: int = 0) -> DataFrame:
    """Changes that add rows."""
    return _rows(table, rows, seq, "add", False, True)


def removes(table: TableDef, rows: DataFrame, seq: int = 0) -> DataFrame:
    """Changes that remove rows."""
    return _rows(table, rows, seq, "remove", True, False)


def edits(table: TableDef, old: DataFrame, new: DataFrame, seq: int = 0) -> DataFrame:
    """Changes that put ``new`` in the place of the row of ``old`` with the same key."""
    schema = change_schema(table)
    pack = lambda df, n: checked(df, table.df.schema, table.name).select(*(F.col(f"`{c}`").alias(f"__{c}") for c in table.key), F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias(n))
    both = pack(old, "old").join(pack(new, "new"), [f"__{c}" for c in table.key])
    return both.select(F.lit(seq).cast("long").alias("seq"), F.lit("edit").alias("op"), F.col("old").cast(schema["old"].dataType).alias("old"), F.col("new").cast(schema["new"].dataType).alias("new"))


# --- keyed writes -------------------------------------------------------------------


def insert(table: TableDef, rows: DataFrame) -> DataFrame:
    """Add rows; an existing key is an error when the batch is applied."""
    return adds(table, rows)


def insert_ignore(table: TableDef, rows: DataFrame) -> DataFrame:
    """Add the rows whose keys don't exist."""
    return adds(table, rows.join(table.df.select(*table.key), list(table.key), "left_anti"))


def update(table: TableDef, rows: DataFrame) -> DataFrame:
    """Replace the rows whose keys exist; others are left out."""
    return edits(table, table.df.join(rows.select(*table.key), list(table.key), "left_semi"), rows)


def upsert(table: TableDef, rows: DataFrame) -> DataFrame:
    """Replace rows whose keys exist, add the others."""
    return update(table, rows).unionByName(insert_ignore(table, rows))


def delete(table: TableDef, keys: DataFrame) -> DataFrame:
    """Remove the rows of existing keys; others are left out."""
    return removes(table, table.df.join(keys.select(*table.key), list(table.key), "left_semi"))


# --- net effect ---------------------------------------------------------------------


def images(table: TableDef, batch: DataFrame) -> DataFrame:
    """``(seq, step, __key..., before, after, bad)``: an edit that moves a key is a remove and an add.

    ``bad`` marks a change without a known operation or the rows that it needs.
    """
    op = F.col("op")
    bad = op.isNull() | ~op.isin("add", "remove", "edit") | (op.isin("remove", "edit") & F.col("old").isNull()) | (op.isin("add", "edit") & F.col("new").isNull())
    moved = F.lit(False)
    for c in table.key:
        moved = moved | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    none = F.lit(None).cast(batch.schema["new"].dataType)
    out = lambda before, after, step: F.struct(F.lit(step).alias("step"), before.alias("before"), after.alias("after"))
    parts = F.when(bad, F.array(out(F.col("old"), F.col("new"), 0))).when(op == "add", F.array(out(none, F.col("new"), 1))).when(op == "remove", F.array(out(F.col("old"), none, 0)))
    parts = parts.when(moved, F.array(out(F.col("old"), none, 0), out(none, F.col("new"), 1))).otherwise(F.array(out(F.col("old"), F.col("new"), 0)))
    flat = batch.select("seq", bad.alias("bad"), F.explode(parts).alias("p"))
    return flat.select("seq", "p.step", *(F.coalesce(F.col(f"p.before.{c}"), F.col(f"p.after.{c}")).alias(f"__{c}") for c in table.key), "p.before", "p.after", "bad")


def net(table: TableDef, batch: DataFrame) -> DataFrame:
    """The frame of :func:`net_counted` alone."""
    return net_counted(table, batch)[0]


def net_counted(table: TableDef, batch: DataFrame) -> tuple[DataFrame, int]:
    """``(__key..., before, after)``, stored, and its number of rows: one for each key that the batch changes, checked against the table.

    Within a batch, changes of one key follow ``seq``.  A batch that adds a key
    that is there, or removes or edits one that isn't, is refused whole.
    ``before`` is the table's own row, whatever the change says it was.
    """
    keys, row = [f"__{c}" for c in table.key], batch.schema["new"].dataType
    w = Window.partitionBy(*keys).orderBy("seq", "step")
    flat = stored(images(table, batch))
    n = flat.count()
    flat = flat.coalesce(1) if n <= FEW else flat  # in one partition nothing below is exchanged
    base = table.df.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in table.key), F.struct(*(F.col(f"`{c}`") for c in row.names)).cast(row).alias("__old"))  # a cast goes by position
    base = base.join(few(flat.select(*keys).distinct(), n), keys, "left_semi")
    known = flat.withColumn("__there", F.lag(F.col("after").isNotNull()).over(w)).join(few(base, n), keys, "left")
    wrong = F.coalesce("__there", F.col("__old").isNotNull()) != F.col("before").isNotNull()
    by_key = known.groupBy(*keys).agg(F.max_by(F.struct(F.col("after").alias("row")), F.struct("seq", "step")).alias("x"), F.first("__old").alias("before"), F.max("bad").alias("bad"), F.max(wrong).alias("wrong"))
    checked_ = stored(by_key.select(*keys, "before", F.col("x.row").alias("after"), "bad", "wrong"))
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    left, refused = checked_.agg(F.count_if(differs), F.max(F.col("bad") | F.col("wrong"))).first()
    for r in checked_.where("bad or wrong").select("bad", *keys).limit(3).collect() if refused else ():
        if r[0]:
            raise SchemaViolation(f"{table.name}: a change of {tuple(r)[1:]} lacks its operation or its rows")
        raise ConsistencyViolation(f"{table.name}: {tuple(r)[1:]} is added although there, or removed or edited although not")
    return checked_.where(differs).select(*keys, "before", "after"), left


def applied(table: TableDef, changed: DataFrame, most: int | None = None) -> DataFrame:
    """The table's rows after a net batch of at most ``most`` rows."""
    keys = changed.select(*(F.col(f"__{c}").alias(c) for c in table.key))
    new = changed.where("after is not null").select("after.*")
    stay = table.df.join(few(keys, most), list(table.key), "left_anti").select(*(F.col(f"`{c}`") for c in table.columns))  # the join puts the key first
    return stay.unionByName(new)


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``(op, old, new)`` between two frames of one schema with a key, met in one exchange; nulls in keys are equal."""
    cols, keys = old.columns, [f"__{c}" for c in key]

    def pack(df, name, other):
        row = F.struct(*(F.col(f"`{c}`") for c in cols))
        kind = df.select(row.alias("x")).schema["x"].dataType
        return df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(key, keys, strict=True)), row.alias(name), F.lit(None).cast(kind).alias(other))

    both = pack(old, "old", "new").unionByName(pack(new, "new", "old"))
    met = both.groupBy(*keys).agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"))
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("edit")
    return met.where(~F.col("old").eqNullSafe(F.col("new"))).select(op.alias("op"), "old", "new")


def replayed(old: DataFrame, changes: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """``old`` with the changes of :func:`difference` (at most ``most``) made to it; nulls in keys are equal."""
    touched = few(changes.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.`{c}`")).otherwise(F.col(f"old.`{c}`")).alias(f"__{c}") for c in key)), most)
    same = [old[f"`{c}`"].eqNullSafe(touched[f"__{c}"]) for c in key]
    return old.join(touched, same, "left_anti").unionByName(changes.where("new is not null").select("new.*"))

