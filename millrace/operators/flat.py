"""A nested result as flat rows, one for each node of the tree, and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.changes import difference


def levels(df: DataFrame, key: list[str], prefix: str = "") -> DataFrame:
    """``(path, key, pos, row)`` of a view's rows and everything nested in them.

    ``path`` names the relationships from the root, ``key`` is the root's key and
    the positions on the way as JSON, ``row`` the node's own columns as JSON.
    """
    nested = [f for f in df.schema.fields if _is_rows(f.dataType)]
    own = [f.name for f in df.schema.fields if f not in nested]
    root = F.to_json(F.struct(*(F.col(f"`{c}`") for c in key)))
    out = df.select(F.lit("").alias("path"), root.alias("key"), F.lit(0).alias("pos"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in own)), {"ignoreNullFields": "false"}).alias("row"))
    for f in nested:
        out = out.unionByName(_below(df.select(root.alias("key"), F.col(f"`{f.name}`").alias("v")), f.name.lstrip("@"), f.dataType))
    return out


def _is_rows(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) or isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)


def _below(df: DataFrame, path: str, t: T.DataType) -> DataFrame:
    if isinstance(t, T.ArrayType):
        df, t = df.select("key", F.posexplode("v").alias("pos", "v")), t.elementType
    else:
        df = df.where("v is not null").select("key", F.lit(0).alias("pos"), "v")
    nested = [f for f in t.fields if _is_rows(f.dataType)]
    own = [f.name for f in t.fields if f not in nested]
    key = F.concat_ws("/", "key", F.col("pos").cast("string"))
    out = df.select(F.lit(path).alias("path"), key.alias("key"), "pos", F.to_json(F.struct(*(F.col(f"v.`{c}`") for c in own)), {"ignoreNullFields": "false"}).alias("row"))
    for f in nested:
        out = out.unionByName(_below(df.select(key.alias("key"), F.col(f"v.`{f.name}`").alias("v")), f"{path}.{f.name}", f.dataType))
    return out


def flat_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``(op, old, new)`` of the nodes of two states of a view."""
    return difference(levels(old, key), levels(new, key), ["path", "key"])
