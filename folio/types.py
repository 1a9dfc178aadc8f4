"""Types of documents in a statically typed frame, and typed columns.

A field that a schema lacks is missing, which is known when a query is compiled; SQL NULL is an explicit null.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BadValue

# The order of type classes, and the ids and aliases of types.
RANK = {"minKey": 0, "null": 1, "number": 2, "string": 4, "object": 5, "array": 6, "binData": 7, "objectId": 8, "bool": 9, "date": 10, "timestamp": 11, "regex": 12, "maxKey": 13}
TYPE_IDS = {
    1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 6: "undefined", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex",
    12: "dbPointer", 13: "javascript", 14: "symbol", 15: "javascriptWithScope", 16: "int", 17: "timestamp", 18: "long", 19: "decimal", -1: "minKey", 127: "maxKey",
}

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def alias(kind: T.DataType) -> str:
    """The type name of a column's values."""
    if isinstance(kind, T.LongType):
        return "long"
    if isinstance(kind, INTS):
        return "int"
    for kinds, name in ((FLOATS, "double"), (T.DecimalType, "decimal"), (T.StringType, "string"), (T.BooleanType, "bool"), (DATES, "date"), (T.BinaryType, "binData"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), (T.NullType, "null")):
        if isinstance(kind, kinds):
            return name
    raise BadValue(f"no document type for {kind.simpleString()}")


def family(kind: T.DataType) -> str:
    """The type class, which orders values of different types."""
    name = alias(kind)
    return "number" if name in ("int", "long", "double", "decimal") else name


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (*INTS, *FLOATS))


@dataclass(frozen=True)
class Typed:
    """A column and its type; neither for a missing value. `plain` columns hold no NaN, and their nulls are missing."""

    col: Column | None
    kind: T.DataType | None
    plain: bool = False
    constant: object = field(default=None, compare=False)

    @property
    def missing(self) -> bool:
        return self.col is None

    @property
    def null(self) -> bool:
        return isinstance(self.kind, T.NullType)

    @property
    def nan(self) -> bool:
        return isinstance(self.kind, FLOATS) and not self.plain

    def as_null(self) -> Typed:
        return null() if self.missing else self


MISSING = Typed(None, None)


def null() -> Typed:
    return Typed(F.lit(None), T.NullType())


def unify(kinds: list[T.DataType]) -> T.DataType:
    """One type for values of several."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.NullType()
    first = kinds[0]
    if all(is_number(k) for k in kinds):
        return T.DoubleType() if any(isinstance(k, FLOATS) for k in kinds) else T.LongType()
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(unify([k.elementType for k in kinds]))
    if all(isinstance(k, T.StructType) for k in kinds):
        names = list(dict.fromkeys(n for k in kinds for n in k.fieldNames()))
        return T.StructType([T.StructField(n, unify([k[n].dataType for k in kinds if n in k.fieldNames()])) for n in names])
    if all(isinstance(k, DATES) for k in kinds):
        return T.TimestampType()
    if len({family(k) for k in kinds}) > 1 or isinstance(first, T.MapType) and any(k != first for k in kinds):
        raise BadValue("values of different types meet in one column: " + ", ".join(k.simpleString() for k in kinds))
    return first


def cast(value: Typed, kind: T.DataType) -> Column:
    """The column as the unified type."""
    if value.missing or value.null:
        return F.lit(None).cast(kind)
    if value.kind == kind:
        return value.col
    if isinstance(kind, T.StructType):
        have = set(value.kind.fieldNames())
        parts = [cast(Typed(value.col[f.name], value.kind[f.name].dataType) if f.name in have else MISSING, f.dataType).alias(f.name) for f in kind]
        return F.when(value.col.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.NullType):
        inner = value.kind.elementType
        return F.transform(value.col, lambda x: cast(Typed(x, inner), kind.elementType))
    return value.col.cast(kind)


def literal(value: object) -> Typed:
    """A Python value as a typed column."""
    if value is None:
        return null()
    if isinstance(value, bool):
        return Typed(F.lit(value), T.BooleanType(), constant=value)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise BadValue("an integer of more than 64 bits")
        return Typed(F.lit(value).cast("bigint"), T.LongType(), constant=value)
    if isinstance(value, float):
        return Typed(F.lit(value), T.DoubleType(), plain=value == value, constant=value)
    if isinstance(value, str):
        return Typed(F.lit(value), T.StringType(), constant=value)
    if isinstance(value, (bytes, bytearray)):
        return Typed(F.lit(bytes(value)), T.BinaryType(), constant=bytes(value))
    if isinstance(value, dt.datetime):
        return Typed(F.timestamp_micros(F.lit(micros(value))), T.TimestampType(), constant=value)
    if isinstance(value, dt.date):
        return literal(dt.datetime(value.year, value.month, value.day))
    if isinstance(value, (list, tuple)):
        items = [literal(x) for x in value]
        kind = unify([x.kind for x in items])
        return Typed(F.array(*[cast(x, kind) for x in items]), T.ArrayType(kind), constant=value)
    if isinstance(value, dict):
        parts = {k: literal(v) for k, v in value.items()}
        made = F.struct(*[v.col.alias(k) for k, v in parts.items()]) if parts else F.struct()
        return Typed(made, T.StructType([T.StructField(k, v.kind) for k, v in parts.items()]), constant=value)
    raise BadValue(f"no document value: {type(value).__name__}")


def micros(value: dt.datetime) -> int:
    """Microseconds since 1970 in UTC, of which a naive time is."""
    aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    return (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
