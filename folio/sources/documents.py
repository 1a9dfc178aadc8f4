"""Python documents as DataFrames, and the limits they keep to."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import DocumentTooLarge, DocumentValidationFailure
from ..types import literal, unify

# Limits of a document.
MAX_BYTES, MAX_DEPTH, MAX_FIELDS, MAX_NAME = 16 * 1024 * 1024, 100, 10_000, 1024

_counter = itertools.count(int.from_bytes(os.urandom(3), "big"))
_process = os.urandom(5).hex()


def new_id() -> str:
    """24 hex digits: seconds, process, counter."""
    return f"{int(time.time()):08x}{_process}{next(_counter) & 0xFFFFFF:06x}"


def validate(doc: dict) -> None:
    """Raise where a document breaks a limit. Its size is that of its names and values, without framing."""
    fields = size = 0
    todo: list[tuple[object, int]] = [(doc, 1)]
    while todo:
        value, depth = todo.pop()
        if depth > MAX_DEPTH:
            raise DocumentValidationFailure(f"a document is nested over {MAX_DEPTH} levels")
        if isinstance(value, dict):
            fields += len(value)
            for name, v in value.items():
                raw = name.encode()
                if len(raw) > MAX_NAME or b"\0" in raw:
                    raise DocumentValidationFailure("a field name is too long or holds a NUL")
                size += len(raw) + 2
                todo.append((v, depth + isinstance(v, (dict, list, tuple))))
        elif isinstance(value, (list, tuple)):
            todo += [(v, depth + isinstance(v, (dict, list, tuple))) for v in value]
        else:
            size += len(value.encode()) + 5 if isinstance(value, str) else len(value) + 5 if isinstance(value, (bytes, bytearray)) else 8
    if fields > MAX_FIELDS:
        raise DocumentValidationFailure(f"a document has over {MAX_FIELDS} fields")
    if size > MAX_BYTES:
        raise DocumentTooLarge(f"a document has over {MAX_BYTES} bytes")


def conform(value: object, kind: T.DataType) -> object:
    """The value as Spark takes it for the type."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(conform(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [conform(x, kind.elementType) for x in value]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.TimestampType) and isinstance(value, dt.date):
        at = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return value


def schema_of(docs: list[dict], known: T.StructType | None = None) -> T.StructType:
    kinds = [literal(d).kind for d in docs]
    out = unify([*kinds, *([known] if known is not None and known.fields else [])])
    if not isinstance(out, T.StructType):
        return T.StructType([])
    # A column of nothing but nulls needs some type; a known column keeps its own where the values fit it.
    known_kinds = {f.name: f.dataType for f in known} if known is not None else {}
    return T.StructType([T.StructField(f.name, _settled(f.dataType, known_kinds.get(f.name))) for f in out])


def _settled(kind: T.DataType, known: T.DataType | None) -> T.DataType:
    if isinstance(kind, T.NullType):
        return known or T.StringType()
    if isinstance(kind, T.LongType) and isinstance(known, (T.IntegerType, T.ShortType, T.ByteType)):
        return known
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType, known[f.name].dataType if isinstance(known, T.StructType) and f.name in known.fieldNames() else None)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType, known.elementType if isinstance(known, T.ArrayType) else None))
    return kind


def to_frame(spark: SparkSession, docs: list[dict], known: T.StructType | None = None) -> DataFrame:
    schema = schema_of(docs, known)
    return spark.createDataFrame([conform(d, schema) for d in docs], schema)
