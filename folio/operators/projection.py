"""Inclusion and exclusion of fields, into documents and arrays of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue
from ..paths import quoted
from ..types import Typed
from .frame import Frame


def tree(paths: list[str]) -> dict:
    """Paths as nested dicts with None at their ends; of colliding paths the last one holds."""
    root: dict = {}
    for path in paths:
        at, parts = root, path.split(".")
        if not all(parts):
            raise BadValue(f"an empty part in the path {path!r}")
        for name in parts[:-1]:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[parts[-1]] = None
    return root


def project(v: Typed, spec: dict | None, include: bool) -> Typed | None:
    """The value with the tree's fields only, or without them; None if nothing is left of it."""
    if spec is None:
        return v if include else None
    if isinstance(v.kind, T.StructType):
        kept = {}
        for f in v.kind:
            child = Typed(v.col.getField(f.name), f.dataType, v.plain)
            if f.name in spec:
                child = project(child, spec[f.name], include)
            elif include:
                continue
            if child is not None:
                kept[f.name] = child
        made = F.struct(*[x.col.alias(n) for n, x in kept.items()]) if kept else F.struct()
        return Typed(F.when(v.col.isNotNull(), made), T.StructType([T.StructField(n, x.kind) for n, x in kept.items()]), v.plain)
    if isinstance(v.kind, T.ArrayType):
        inner = v.kind.elementType
        if not isinstance(inner, (T.StructType, T.ArrayType)):
            # Elements that are no documents go on inclusion and stay on exclusion.
            return Typed(F.when(v.col.isNotNull(), F.filter(v.col, lambda x: F.lit(False))), v.kind) if include else v
        kind = project(Typed(F.lit(None).cast(inner), inner), spec, include).kind
        return Typed(F.transform(v.col, lambda x: project(Typed(x, inner), spec, include).col), T.ArrayType(kind))
    return None if include else v


def excludes(flag: object) -> bool:
    """False and whole zeros exclude; a zero with a fraction part includes, as any other number does."""
    return flag is False or isinstance(flag, int) and flag == 0


def apply(frame: Frame, spec: dict) -> Frame:
    """A projection of flags: inclusion if any field but _id is included."""
    for path, flag in spec.items():
        if not isinstance(flag, (bool, int, float)):
            raise BadValue(f"the projection of {path!r} is no flag")
        if path.startswith("$") or ".$" in path:
            raise BadValue("positional projection is not supported")
    ids = {"_id", frame.id_col} - {None}
    include = any(not excludes(f) for p, f in spec.items() if p not in ids)
    wanted = [p for p, f in spec.items() if p not in ids and excludes(f) != include]
    drop_id = any(excludes(f) for p, f in spec.items() if p in ids)
    if not include and not wanted and not drop_id:
        include = any(p in ids for p in spec)
    nested, out = tree(wanted), []
    for f in frame.df.schema:
        v = Typed(quoted(f.name), f.dataType, frame.plain)
        if f.name == frame.id_col or f.name == "_id":
            v = None if drop_id else v
        elif f.name in nested:
            v = project(v, nested[f.name], include)
        elif include:
            v = None
        if v is not None:
            out.append(v.col.alias(f.name))
    return frame.with_df(frame.df.select(*out), id_col=None if drop_id else frame.id_col)
