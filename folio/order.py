"""The canonical order of values: null, numbers (NaN first), strings, documents, arrays, binary, booleans, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import RANK, Typed, family, is_number, unify


def _sides(a: Typed, b: Typed) -> tuple[Column, Column]:
    if is_number(a.kind) and is_number(b.kind) and a.kind != b.kind:
        kind = unify([a.kind, b.kind])
        # A literal takes the column's type where it can, so that the column stays bare and is pushed to the scan.
        if isinstance(b.constant, int) and isinstance(a.kind, T.IntegerType) and -(2**31) <= b.constant < 2**31:
            return a.col, F.lit(b.constant)
        if b.constant is not None and isinstance(a.kind, T.DoubleType):
            return a.col, F.lit(float(b.constant))
        return a.col.cast(kind), b.col.cast(kind)
    return a.col, b.col


def equal(a: Typed, b: Typed) -> Column:
    """Canonical equality, two-valued; missing counts as null."""
    a, b = a.as_null(), b.as_null()
    if a.null and b.null:
        return F.lit(True)
    if a.null or b.null:
        return (b if a.null else a).col.isNull()
    if family(a.kind) != family(b.kind):
        return a.col.isNull() & b.col.isNull()
    x, y = _sides(a, b)
    if b.constant is not None:
        return x == y  # null only where x is, which no predicate takes for true
    return x.eqNullSafe(y)


def less(a: Typed, b: Typed, or_equal: bool = False) -> Column:
    """Canonical a < b (or <=), two-valued where both sides are columns; nulls are smallest."""
    a, b = a.as_null(), b.as_null()
    if a.null and b.null:
        return F.lit(or_equal)
    if a.null:
        return F.lit(True) if or_equal else b.col.isNotNull()
    if b.null:
        return a.col.isNull() if or_equal else F.lit(False)
    if family(a.kind) != family(b.kind):
        below = RANK[family(a.kind)] < RANK[family(b.kind)]
        both = F.lit(below)
    else:
        x, y = _sides(a, b)
        both = x <= y if or_equal else x < y
        if a.nan or b.nan:
            na = F.isnan(x) if a.nan else F.lit(False)
            nb = F.isnan(y) if b.nan else F.lit(False)
            both = F.when(na, F.lit(True) if or_equal else ~nb).when(nb, F.lit(False)).otherwise(both)
    if a.plain and b.constant is not None or b.plain and a.constant is not None:
        return both
    small = F.lit(True) if or_equal else b.col.isNotNull()
    if b.constant is not None:
        return a.col.isNull() | both
    if a.constant is not None:
        return b.col.isNotNull() & both
    return F.when(a.col.isNull(), small).when(b.col.isNull(), F.lit(False)).otherwise(both)


def compare(a: Typed, b: Typed) -> Column:
    return F.when(F.coalesce(less(a, b), F.lit(False)), -1).when(F.coalesce(equal(a, b), F.lit(False)), 0).otherwise(1)


def sort_keys(value: Typed, direction: int) -> list[Column]:
    """Spark sort expressions of one key; a missing key sorts nothing."""
    if value.missing or value.null:
        return []
    keys = [value.col]
    if value.nan:
        keys.insert(0, F.when(value.col.isNull(), 0).when(F.isnan(value.col), 1).otherwise(2))
    return [k.asc_nulls_first() if direction > 0 else k.desc_nulls_last() for k in keys]


def ordered(value: Typed) -> Column:
    """A key that Spark's own comparison of structs, min and max orders canonically; null where the value is."""
    if value.nan:
        return F.when(value.col.isNotNull(), F.struct((~F.isnan(value.col)).alias("number"), value.col.alias("value")))
    return value.col
