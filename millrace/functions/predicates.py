"""Comparisons of a column with a literal, under the query language's rules.

A null cell fails all comparisons but IS: each predicate is guarded by a null
check, which filters can push down to the scan as they can the comparison.  Numbers compare by value, exactly, whatever their types; other types
only compare with their own, and order by kind where kinds differ: booleans,
then numbers, then text.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import Invalid
from millrace.plans.ast import Literal, Simple
from millrace.plans.ast import Column as Field

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RANK = {"bool": 0, "number": 1, "text": 2, "other": 3}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(t: T.DataType) -> str:
    """``bool``, ``number``, ``text`` or ``other`` (times, which compare with their own text form)."""
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    return "text" if isinstance(t, T.StringType) else "other"


def literal_kind(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float, Decimal)) else "text" if isinstance(v, str) else "other"


def _flag(value: bool) -> Column:
    return F.lit(value)


def _order(col: Column, t: T.DataType, op: str, v: Any) -> Column | bool:
    """``col op v`` for = < <= > >= on a cell that isn't null; a bool where the cell doesn't matter."""
    own, other = kind_of(t), literal_kind(v)
    if own == "other" and other in ("text", "other"):
        v = F.lit(v).cast(t)
    elif own != other:
        if op == "=":
            return False
        return (_RANK[own] < _RANK[other]) == (op in ("<", "<="))
    elif own == "number":
        return _numeric(col, t, op, v)
    return {"=": col.__eq__, "<": col.__lt__, "<=": col.__le__, ">": col.__gt__, ">=": col.__ge__}[op](v if isinstance(v, Column) else F.lit(v))


def _numeric(col: Column, t: T.DataType, op: str, v: Any) -> Column | bool:
    if isinstance(t, _INTEGRAL):
        if isinstance(v, float) and not v.is_integer():
            if op == "=":
                return False
            # below v: up to its floor; above v: from its ceiling
            op, v = ("<=", math.floor(v)) if op in ("<", "<=") else (">=", math.ceil(v))
        v = int(v)
        if not -(2**63) <= v < 2**63:
            return False if op == "=" else (v > 0) == (op in ("<", "<="))
        right = F.lit(v)
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        near = float(v)
        if isinstance(v, int) and int(near) != v:  # no double is equal to v
            if op == "=":
                return False
            below = near < v
            op = ("<=" if below else "<") if op in ("<", "<=") else (">" if below else ">=")
        col, right = col.cast("double"), F.lit(near)
    else:
        right = F.lit(Decimal(str(v)))
    return {"=": col == right, "<": col < right, "<=": col <= right, ">": col > right, ">=": col >= right}[op]


def spark_pattern(pattern: str) -> str:
    """A LIKE pattern with every backslash that escapes nothing doubled, as Spark wants it."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            out.append("\\" + following if following and following in "%_\\" else "\\\\")
            i += 2 if following and following in "%_\\" else 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def ascii_lower(s: str) -> str:
    """A-Z lower-cased, nothing else."""
    return s.translate({ord(c): c.lower() for c in _UPPER})


def _like(col: Column, pattern: str, fold: bool, by_byte: bool) -> Column:
    if fold:
        col, pattern = F.translate(col, _UPPER, _UPPER.lower()), ascii_lower(pattern)
    if by_byte:
        col, pattern = F.decode(col.cast("binary"), "ISO-8859-1"), pattern.encode().decode("latin-1")
    return col.like(spark_pattern(pattern))


def predicate(col: Column, t: T.DataType, op: str, v: Any, by_byte: bool = False) -> Column:
    """``col op v`` as a column that is true or false; never null.

    ``by_byte`` makes ``_`` in a pattern stand for one byte rather than one character.
    """
    some = col.isNotNull()
    if op in ("IS", "IS NOT"):
        if v is None:
            return col.isNull() if op == "IS" else some
        same = _order(col, t, "=", v)
        same = _flag(same) if isinstance(same, bool) else some & same
        return same if op == "IS" else ~same
    if op in ("IN", "NOT IN"):
        if not isinstance(v, (list, tuple)):
            raise Invalid(f"{op} needs a list")
        within = _within(col, t, [x for x in v if x is not None])
        return some & (within if op == "IN" else ~within)
    if isinstance(v, (list, tuple)):
        raise Invalid(f"{op} takes no list")
    if v is None:
        return _flag(False)
    if op.endswith("LIKE"):
        if kind_of(t) != "text" or not isinstance(v, str):
            return some if op.startswith("NOT") else _flag(False)
        hit = _like(col, v, "ILIKE" in op, by_byte)
        return some & (~hit if op.startswith("NOT") else hit)
    negated = op == "!="
    hit = _order(col, t, "=" if negated else op, v)
    if isinstance(hit, bool):
        return some if hit != negated else _flag(False)
    return some & (~hit if negated else hit)


def _within(col: Column, t: T.DataType, values: list) -> Column:
    plain = [v for v in values if kind_of(t) == literal_kind(v) and kind_of(t) in ("text", "bool")]
    if kind_of(t) == "number" and isinstance(t, _INTEGRAL):
        plain = [int(v) for v in values if literal_kind(v) == "number" and float(v).is_integer() and -(2**63) <= int(v) < 2**63]
    elif kind_of(t) == "number":
        hits = [h for v in values if literal_kind(v) == "number" and not isinstance(h := _numeric(col, t, "=", v), bool)]
        return _any(hits)
    elif kind_of(t) == "other":
        return _any([_order(col, t, "=", v) for v in values if isinstance(v, str)])
    return col.isin(*plain) if plain else F.lit(False)


def _any(hits: list[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def _like_text(text: str, pattern: str) -> bool:
    import re

    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1 : i + 2] and pattern[i + 1] in "%_\\":
            out.append(re.escape(pattern[i + 1]))
            i += 1
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    return re.fullmatch("".join(out), text, re.S) is not None


def fold(left: Any, op: str, right: Any) -> bool:
    """A comparison of two literals, at build time."""
    if op in ("IS", "IS NOT"):
        same = left is None and right is None or (left is not None and right is not None and literal_kind(left) == literal_kind(right) and left == right)
        return same == (op == "IS")
    if op in ("IN", "NOT IN"):
        if not isinstance(right, (list, tuple)):
            raise Invalid(f"{op} needs a list")
        if left is None:
            return False
        return any(fold(left, "IS", x) for x in right if x is not None) == (op == "IN")
    if left is None or right is None:
        return False
    if op.endswith("LIKE"):
        if not (isinstance(left, str) and isinstance(right, str)):
            return op.startswith("NOT")
        a, b = (ascii_lower(left), ascii_lower(right)) if "ILIKE" in op else (left, right)
        return _like_text(a, b) != op.startswith("NOT")
    same_kind = literal_kind(left) == literal_kind(right)
    if op in ("=", "!="):
        return (same_kind and left == right) == (op == "=")
    if not same_kind:
        raise Invalid("literals of different kinds have no order")
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def simple(c: Simple, column, by_byte: bool = False) -> Column:
    """A comparison as a column; ``column(name)`` gives a field's column and type."""
    if isinstance(c.right, Field):
        raise Invalid("the right side of a comparison is a literal")
    if isinstance(c.left, Literal):
        return F.lit(fold(c.left.value, c.op, c.right.value))
    col, t = column(c.left.name)
    return predicate(col, t, c.op, c.right.value, by_byte)
