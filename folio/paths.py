"""Resolution of dotted paths, and rebuilding of nested fields.

A path walks documents. At an array, the whole rest of the path may be one index; no path reaches into an array's
documents. What a schema lacks is missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BadValue
from .types import MISSING, Typed


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def step(base: Typed, segments: list[str]) -> Typed:
    """The value at the path below base."""
    for i, name in enumerate(segments):
        if base.missing or base.null:
            return MISSING
        if isinstance(base.kind, T.StructType):
            if name not in base.kind.fieldNames():
                return MISSING
            base = Typed(base.col.getField(name), base.kind[name].dataType, base.plain)
        elif isinstance(base.kind, T.MapType):
            base = Typed(base.col.getItem(name), base.kind.valueType, base.plain)
        elif isinstance(base.kind, T.ArrayType) and i == len(segments) - 1 and name.isdigit():
            return Typed(F.get(base.col, int(name)), base.kind.elementType, base.plain)
        else:
            return MISSING
    return base


@dataclass(frozen=True)
class Env:
    """What expressions see: the document's fields, variables, and the time of the query."""

    schema: T.StructType
    now: object = None
    plain: bool = False
    variables: dict[str, Typed] = field(default_factory=dict)
    base: Column | None = None
    id_col: str | None = None

    def bind(self, name: str, value: Typed) -> Env:
        return replace(self, variables=self.variables | {name: value})

    def root(self) -> Typed:
        """The whole document; columns whose names begin with __ are the engine's own."""
        if self.base is not None:
            return Typed(self.base, self.schema, self.plain)
        fields = [f for f in self.schema if not f.name.startswith("__")]
        return Typed(F.struct(*[quoted(f.name).alias(f.name) for f in fields]), T.StructType(fields), self.plain)

    def field(self, path: str) -> Typed:
        segments = path.split(".")
        if not all(segments):
            raise BadValue(f"an empty part in the path {path!r}")
        first = segments[0]
        if first == "_id" and self.id_col and "_id" not in self.schema.fieldNames():
            first = self.id_col  # a table's declared identifier answers to _id
        if first not in self.schema.fieldNames():
            return MISSING
        top = self.base.getField(first) if self.base is not None else quoted(first)
        return step(Typed(top, self.schema[first].dataType, self.plain), segments[1:])


def assign(base: Typed, segments: list[str], value: Typed) -> Typed:
    """The document with the value at the path; what stands in the way and is no document is replaced by one.

    A missing value removes nothing and adds nothing.
    """
    name, rest = segments[0], segments[1:]
    if value.missing:
        return base
    held = step(base, [name]) if not base.missing and isinstance(base.kind, T.StructType) else MISSING
    new = assign(held, rest, value) if rest else value
    if base.missing or not isinstance(base.kind, T.StructType):
        return Typed(F.struct(new.col.alias(name)), T.StructType([T.StructField(name, new.kind)]))
    kinds = [T.StructField(name, new.kind) if f.name == name else f for f in base.kind]
    if name not in base.kind.fieldNames():
        kinds.append(T.StructField(name, new.kind))
    parts = [(new.col if f.name == name else base.col.getField(f.name)).alias(f.name) for f in kinds]
    return Typed(F.struct(*parts), T.StructType(kinds), base.plain)
