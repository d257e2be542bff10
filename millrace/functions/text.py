"""Small formatters: times as numbers, changes as sentences, names of aggregates."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ast import Related, to_json


def epoch_ms(column: str) -> Column:
    """A timestamp or date column as milliseconds since 1970, UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def narrated(changes: DataFrame, templates: dict[str, str]) -> DataFrame:
    """``(op, text)`` of changes: ``{new.name}`` and ``{old.name}`` in the template of an operation stand for cells."""
    out = F.lit(None).cast("string")
    for op, template in templates.items():
        parts = []
        for i, piece in enumerate(re.split(r"\{((?:old|new)\.\w+)\}", template)):
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("nothing")) if i % 2 else F.lit(piece))
        out = F.when(F.col("op") == op, F.concat(*parts)).otherwise(out)
    return changes.select("op", out.alias("text"))


def aggregate_name(r: Related) -> str:
    """The name of a table that holds a child aggregate, the same for the same aggregate."""
    text = f"{r.query.table}|{','.join(r.child)}|{to_json(r.query.with_(alias=None))}"
    return f"agg_{r.query.table}_{hashlib.sha256(text.encode()).hexdigest()[:12]}"
