"""Small sets of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; a bound on how many there are is known before.
FEW = 10_000


def few(keys: DataFrame, most: int | None) -> DataFrame:
    """A frame of keys, broadcast where it is known to have few rows."""
    return F.broadcast(keys) if most is not None and most <= FEW else keys
