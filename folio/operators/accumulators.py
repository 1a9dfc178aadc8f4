"""Accumulators of a group as Spark aggregates.

Order-sensitive ones follow the frame's order explicitly, so a result never depends on how rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue, UnsupportedOperator
from ..functions.expr import compile_expr
from ..order import ordered
from ..paths import Env
from ..types import INTS, Typed, is_number
from .frame import Frame

LONG, DOUBLE = T.LongType(), T.DoubleType()


def compile_accumulator(name: str, spec: object, frame: Frame) -> tuple[Column, T.DataType]:
    """The aggregate of one output field and its type."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise BadValue(f"the field {name!r} needs exactly one accumulator")
    op, arg = next(iter(spec.items()))
    if op not in ACCUMULATORS:
        raise UnsupportedOperator(f"unsupported accumulator {op}")
    return ACCUMULATORS[op](arg, frame.env(), frame)


def _value(arg: object, env: Env) -> Typed:
    if isinstance(arg, (list, tuple)) and len(arg) != 1:
        raise BadValue("an accumulator takes one argument")
    return compile_expr(arg[0] if isinstance(arg, (list, tuple)) else arg, env)


def _sum(arg, env, frame):
    v = _value(arg, env)
    if v.missing or not is_number(v.kind):
        return F.coalesce(F.sum(F.lit(0).cast("bigint")), F.lit(0)).cast(LONG), LONG
    kind = LONG if isinstance(v.kind, INTS) else DOUBLE
    return F.coalesce(F.sum(v.col.cast(kind) if kind != v.kind else v.col), F.lit(0).cast(kind)), kind


def _numeric(made: Callable[[Column], Column]):
    def build(arg, env, frame):
        v = _value(arg, env)
        if v.missing or not is_number(v.kind):
            return F.max(F.lit(None).cast(DOUBLE)), DOUBLE
        return made(v.col.cast(DOUBLE)), DOUBLE

    return build


def _extreme(made: Callable[[Column], Column]):
    def build(arg, env, frame):
        v = _value(arg, env).as_null()
        best = made(ordered(v))
        return (best.getField("value") if v.nan else best), v.kind

    return build


def _end(made: Callable[[Column, Column], Column]):
    def build(arg, env, frame):
        v = _value(arg, env).as_null()
        return made(F.struct(v.col.alias("x")), frame.place()).getField("x"), v.kind

    return build


def _listed(v: Typed, frame: Frame) -> Column:
    """The group's values in order, nulls too but where they are missing fields."""
    rows = F.array_sort(F.collect_list(_there(v, F.struct(frame.place().alias("at"), v.col.alias("x")))))
    return F.transform(rows, lambda r: r["x"])


def _there(v: Typed, made: Column) -> Column:
    """made, or null where v is a missing field: what is collected skips it."""
    return F.when(v.col.isNotNull(), made) if v.plain else made


def _push(arg, env, frame):
    v = _value(arg, env)
    if v.missing:
        return F.max(F.array().cast("array<string>")), T.ArrayType(T.StringType())
    return _listed(v, frame), T.ArrayType(v.kind)


def _add_to_set(arg, env, frame):
    """The distinct values, nulls too but where they are missing fields; their order is the canonical one."""
    v = _value(arg, env)
    if v.missing:
        return F.max(F.array().cast("array<string>")), T.ArrayType(T.StringType())
    return F.transform(F.array_sort(F.collect_set(_there(v, F.struct(v.col.alias("x"))))), lambda r: r["x"]), T.ArrayType(v.kind)


def _count(arg, env, frame):
    if arg != {}:
        raise BadValue("$count takes no argument")
    return F.count(F.lit(1)), LONG


def _merge_objects(arg, env, frame):
    """Field by field, the last document's value that is not null: a null and a missing field look the same here."""
    v = _value(arg, env).as_null()
    if v.null:
        return F.max(F.struct()), T.StructType([])
    if not isinstance(v.kind, T.StructType):
        raise BadValue("$mergeObjects needs documents")
    at = frame.place()
    parts = [F.max_by(v.col.getField(f.name), F.when(v.col.getField(f.name).isNotNull(), at)).alias(f.name) for f in v.kind]
    return F.struct(*parts), v.kind


def _several(arg, env) -> tuple[Typed, int]:
    if not isinstance(arg, dict) or set(arg) != {"input", "n"}:
        raise BadValue("an accumulator of n values needs input and n")
    n = arg["n"]
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n) or n < 1:
        raise BadValue("n is a positive whole number")
    return compile_expr(arg["input"], env), int(n)


def _n_of(take: Callable[[Column, int], Column], by_value: bool):
    def build(arg, env, frame):
        v, n = _several(arg, env)
        if v.missing:
            return F.max(F.array().cast("array<string>")), T.ArrayType(T.StringType())
        if not by_value:
            return take(_listed(v, frame), n), T.ArrayType(v.kind)
        values = F.array_sort(F.collect_list(ordered(v)))
        return take(F.transform(values, lambda r: r["value"]) if v.nan else values, n), T.ArrayType(v.kind)

    return build


@dataclass(frozen=True)
class Bounded:
    """An accumulator of n values as a ranking: the first n by `at`, or the last n, of the documents that `there` picks."""

    value: Typed
    n: int
    at: Column
    there: Column | None
    falling: bool
    turned: bool  # listed from the largest down


def bounded(spec: object, frame: Frame) -> Bounded | None:
    """The ranking of an accumulator of n values, None for all others and where the value has no type to list."""
    op = next(iter(spec)) if isinstance(spec, dict) and len(spec) == 1 else None
    if op not in ("$firstN", "$lastN", "$minN", "$maxN"):
        return None
    v, n = _several(spec[op], frame.env())
    if v.missing or v.null:
        return None
    if op in ("$minN", "$maxN"):
        return Bounded(v, n, ordered(v), v.col.isNotNull(), op == "$maxN", op == "$maxN")
    place = F.struct(frame.place().alias("at"), v.col.alias("x"))
    return Bounded(v, n, place, v.col.isNotNull() if v.plain else None, op == "$lastN", False)


ACCUMULATORS = {
    "$sum": _sum,
    "$avg": _numeric(F.avg),
    "$min": _extreme(F.min),
    "$max": _extreme(F.max),
    "$first": _end(F.min_by),
    "$last": _end(F.max_by),
    "$push": _push,
    "$addToSet": _add_to_set,
    "$count": _count,
    "$stdDevPop": _numeric(F.stddev_pop),
    "$stdDevSamp": _numeric(F.stddev_samp),
    "$mergeObjects": _merge_objects,
    "$firstN": _n_of(lambda a, n: F.slice(a, 1, n), False),
    "$lastN": _n_of(lambda a, n: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n)), False),
    "$minN": _n_of(lambda a, n: F.slice(a, 1, n), True),
    "$maxN": _n_of(lambda a, n: F.slice(F.reverse(a), 1, n), True),
}
