"""Updates as DataFrame transforms: each touched column becomes the new value where the row is updated."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue
from ..functions.expr import compile_expr
from ..order import equal, less
from ..paths import Env, quoted
from ..types import INTS, MISSING, Typed, cast, is_number, literal, null, unify
from . import projection
from .filters import compile_filter, element, is_operators
from .frame import Frame
from .stages import run_pipeline

#: What one value becomes; MISSING stands for its removal.
Change = Callable[[Typed], Typed]


@dataclass(frozen=True)
class Context:
    """The query's conditions, for $, and filters of elements by name, for $[name]."""

    query: dict
    array_filters: dict[str, dict] = field(default_factory=dict)
    now: dt.datetime | None = None


def parse_array_filters(filters: list[dict] | None, update: dict) -> dict[str, dict]:
    """Element filters by identifier, in terms of the element: {"e.k": 1} as {"k": 1}, {"e": {...}} as operators."""
    out: dict[str, dict] = {}
    for one in filters or []:
        names = {k.split(".")[0] for k in one}
        if len(names) != 1 or (name := names.pop()) in out or not name.isidentifier():
            raise BadValue("an array filter has one identifier, and each is filtered once")
        out[name] = {"": one[name]} if set(one) == {name} else {k.split(".", 1)[1]: v for k, v in one.items() if "." in k}
    used = {s[2:-1] for op in update.values() if isinstance(op, dict) for path in op for s in path.split(".") if s.startswith("$[") and len(s) > 3}
    if unused := set(out) - used:
        raise BadValue(f"unused array filter {min(unused)}")
    if absent := used - set(out):
        raise BadValue(f"no array filter for {min(absent)}")
    return out


def _element_test(x: Typed, spec: dict) -> Column:
    if set(spec) == {""}:
        want = spec[""]
        return element(x, want) if is_operators(want) else equal(x, literal(want))
    return element(x, spec)


def _positional_test(x: Typed, path: list[str], query: dict) -> Column | None:
    """The query's conditions on the array at the path, as a test of one element."""
    name, tests = ".".join(path), []
    for key, arg in query.items():
        if key == "$and":
            tests += [t for one in arg if (t := _positional_test(x, path, one)) is not None]
        elif key == name:
            if is_operators(arg) and "$elemMatch" in arg:
                tests.append(element(x, arg["$elemMatch"]))
            else:
                tests.append(element(x, arg) if is_operators(arg) else equal(x, literal(arg)))
        elif key.startswith(name + "."):
            tests.append(element(x, {key[len(name) + 1 :]: arg}))
    if not tests:
        return None
    out = F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out


def modify(base: Typed, segments: list[str], change: Change, ctx: Context, seen: tuple[str, ...] = ()) -> Typed:
    """The value with the change made at the path below it."""
    if not segments:
        return change(base)
    name, rest = segments[0], segments[1:]
    if name == "$" or name.startswith("$["):
        if base.missing or not isinstance(base.kind, T.ArrayType):
            raise BadValue(f"{'.'.join(seen)} is no array")
        return _modify_elements(base, name, rest, change, ctx, seen)
    if not base.missing and isinstance(base.kind, T.StructType):
        held = Typed(base.col.getField(name), base.kind[name].dataType, base.plain) if name in base.kind.fieldNames() else MISSING
        new = modify(held, rest, change, ctx, (*seen, name))
        kept = {f.name: Typed(base.col.getField(f.name), f.dataType, base.plain) for f in base.kind}
        if new.missing:
            kept.pop(name, None)
        else:
            kept[name] = new
        made = F.struct(*[v.col.alias(n) for n, v in kept.items()]) if kept else F.struct()
        return Typed(made, T.StructType([T.StructField(n, v.kind) for n, v in kept.items()]))
    new = modify(MISSING, rest, change, ctx, (*seen, name))
    if new.missing:
        return base  # nothing to remove, and no parents are made for it
    return Typed(F.struct(new.col.alias(name)), T.StructType([T.StructField(name, new.kind)]))


def _modify_elements(base: Typed, name: str, rest: list[str], change: Change, ctx: Context, seen: tuple[str, ...]) -> Typed:
    inner = base.kind.elementType
    if rest and not isinstance(inner, (T.StructType, T.ArrayType)):
        return base  # elements that are no documents are left alone
    below = (*seen, name)
    probe = modify(Typed(F.lit(None).cast(inner), inner), rest, change, ctx, below)
    kind = unify([inner, probe.kind]) if not probe.missing else inner
    made = lambda x: cast(v if not (v := modify(Typed(x, inner), rest, change, ctx, below)).missing else null(), kind)
    old = lambda x: cast(Typed(x, inner), kind)
    if name == "$[]":
        return Typed(F.transform(base.col, made), T.ArrayType(kind))
    if name == "$":
        if "$" in seen:
            raise BadValue("one $ a path at most")
        if _positional_test(Typed(F.lit(None).cast(inner), inner), list(seen), ctx.query) is None:
            raise BadValue("the query has no condition on the array of $")
        hits = F.transform(base.col, lambda x: _positional_test(Typed(x, inner), list(seen), ctx.query))
        at = F.array_position(hits, True)
        return Typed(F.transform(base.col, lambda x, i: F.when(i + 1 == at, made(x)).otherwise(old(x))), T.ArrayType(kind))
    spec = ctx.array_filters.get(name[2:-1])
    if spec is None:
        raise BadValue(f"no array filter for {name[2:-1]}")
    return Typed(F.transform(base.col, lambda x: F.when(F.coalesce(_element_test(Typed(x, inner), spec), F.lit(False)), made(x)).otherwise(old(x))), T.ArrayType(kind))


# -- the changes of operators


def _set(arg: object, ctx: Context) -> Change:
    value = literal(arg)
    return lambda old: value


def _unset(arg: object, ctx: Context) -> Change:
    return lambda old: MISSING


def _arithmetic(made: Callable[[Column, Column], Column]) -> Callable:
    def build(arg: object, ctx: Context) -> Change:
        by = literal(arg)
        if not is_number(by.kind):
            raise BadValue("the operand is no number")

        def change(old: Typed) -> Typed:
            if old.missing or old.null:
                return Typed(made(F.lit(0.0), by.col.cast("double")), T.DoubleType())
            if not is_number(old.kind):
                raise BadValue("the field holds no numbers")
            kind = T.LongType() if isinstance(old.kind, INTS) and isinstance(by.kind, INTS) else T.DoubleType()
            now = made(F.coalesce(old.col, F.lit(0).cast(old.kind)).cast(kind), by.col.cast(kind))
            # An integer field stays one: what an operand with a fraction adds is cut off.
            return Typed(now.cast(old.kind) if isinstance(old.kind, INTS) else now, old.kind)

        return change

    return build


def _bound(takes_new: Callable[[Typed, Typed], Column]) -> Callable:
    def build(arg: object, ctx: Context) -> Change:
        new = literal(arg)

        def change(old: Typed) -> Typed:
            if old.missing:
                return new
            kind = unify([old.kind, new.kind])
            return Typed(F.when(F.coalesce(takes_new(old, new), F.lit(False)), cast(new, kind)).otherwise(cast(old, kind)), kind)

        return change

    return build


def _current_date(arg: object, ctx: Context) -> Change:
    if arg is True or arg == {"$type": "date"}:
        value = literal(ctx.now)
    elif arg == {"$type": "timestamp"}:
        seconds = int(ctx.now.replace(tzinfo=dt.timezone.utc).timestamp())
        value = Typed(F.struct(F.lit(seconds).alias("t"), F.lit(1).alias("i")), T.StructType([T.StructField("t", T.IntegerType()), T.StructField("i", T.IntegerType())]))
    else:
        raise BadValue("$currentDate takes true or a $type")
    return lambda old: value


def _bit(arg: object, ctx: Context) -> Change:
    if not isinstance(arg, dict) or len(arg) != 1 or (op := next(iter(arg))) not in ("and", "or", "xor"):
        raise BadValue("$bit takes one of and, or, xor")
    by = arg[op]
    if isinstance(by, bool) or not isinstance(by, int):
        raise BadValue("$bit needs an integer")
    made = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[op]

    def change(old: Typed) -> Typed:
        if not old.missing and not old.null and not isinstance(old.kind, INTS):
            raise BadValue("$bit needs an integer field")
        value = F.lit(0).cast("bigint") if old.missing or old.null else F.coalesce(old.col.cast("bigint"), F.lit(0).cast("bigint"))
        kind = old.kind if not old.missing and isinstance(old.kind, INTS) and abs(by) < 2**31 else T.LongType()
        return Typed(made(value, F.lit(by).cast("bigint")).cast(kind), kind)

    return change


def _array_of(old: Typed, items: list[object]) -> tuple[Column, Column, T.DataType]:
    """The field as an array, the items as one, and the type of their elements."""
    if not old.missing and not old.null and not isinstance(old.kind, T.ArrayType):
        raise BadValue("the field holds no array")
    given = [literal(x) for x in items]
    kinds = [v.kind for v in given] + ([] if old.missing or old.null else [old.kind.elementType])
    kind = unify(kinds) if kinds else T.StringType()
    have = F.array().cast(T.ArrayType(kind)) if old.missing or old.null else F.coalesce(cast(old, T.ArrayType(kind)), F.array().cast(T.ArrayType(kind)))
    return have, F.array(*[cast(v, kind) for v in given]) if given else F.array().cast(T.ArrayType(kind)), kind


def _each(arg: object, allowed: set[str]) -> tuple[list[object], dict]:
    if isinstance(arg, dict) and "$each" in arg:
        if set(arg) - allowed or not isinstance(arg["$each"], (list, tuple)):
            raise BadValue("$each needs an array")
        return list(arg["$each"]), arg
    return [arg], {}


def _push(arg: object, ctx: Context) -> Change:
    items, more = _each(arg, {"$each", "$position", "$sort", "$slice"})
    for name in ("$position", "$slice"):
        if name in more and (isinstance(more[name], bool) or not isinstance(more[name], int)):
            raise BadValue(f"{name} is a whole number")

    def change(old: Typed) -> Typed:
        have, new, kind = _array_of(old, items)
        if "$position" in more:
            n, p = F.size(have), more["$position"]
            at = F.least(F.lit(p), n) if p >= 0 else F.greatest(n + p, F.lit(0))
            made = F.concat(F.slice(have, F.lit(1), at), new, F.slice(have, at + 1, F.greatest(n - at, F.lit(0))))
        else:
            made = F.concat(have, new)
        if "$sort" in more:
            made = F.array_sort(made, _comparator(more["$sort"], kind))
        if "$slice" in more:
            k = more["$slice"]
            made = F.slice(made, 1, k) if k >= 0 else F.slice(made, F.greatest(F.size(made) + k, F.lit(0)) + 1, F.lit(-k))
        return Typed(made, T.ArrayType(kind))

    return change


def _comparator(spec: object, kind: T.DataType) -> Callable[[Column, Column], Column]:
    keys = spec.items() if isinstance(spec, dict) else [("", spec)]
    for _, d in keys:
        if isinstance(d, bool) or d not in (1, -1):
            raise BadValue("$sort's direction is 1 or -1")

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, d in reversed(list(keys)):
            x, y = (Typed(v, kind) if not path else Env(kind, base=v).field(path) if isinstance(kind, T.StructType) else MISSING for v in (a, b))
            out = F.when(F.coalesce(less(x, y), F.lit(False)), -int(d)).when(F.coalesce(less(y, x), F.lit(False)), int(d)).otherwise(out)
        return out

    return compare


def _add_to_set(arg: object, ctx: Context) -> Change:
    items, _ = _each(arg, {"$each"})

    def change(old: Typed) -> Typed:
        have, _, kind = _array_of(old, items)
        for item in items:
            v = literal(item)
            have = F.when(_holds(have, kind, v), have).otherwise(F.concat(have, F.array(cast(v, kind))))
        return Typed(have, T.ArrayType(kind))

    return change


def _holds(array: Column, kind: T.DataType, v: Typed) -> Column:
    return F.exists(array, lambda x: F.coalesce(equal(Typed(x, kind), v), F.lit(False)))


def _removal(test: Callable[[Typed], Column]) -> Change:
    def change(old: Typed) -> Typed:
        if old.missing or old.null:
            return old
        if not isinstance(old.kind, T.ArrayType):
            raise BadValue("the field holds no array")
        return Typed(F.filter(old.col, lambda x: ~F.coalesce(test(Typed(x, old.kind.elementType)), F.lit(False))), old.kind)

    return change


def _pull(arg: object, ctx: Context) -> Change:
    if isinstance(arg, dict):
        # A document is a filter of elements that are documents; others are never removed by one.
        return _removal(lambda x: x.col.isNotNull() & compile_filter(arg, Env(x.kind, base=x.col)) if isinstance(x.kind, T.StructType) else F.lit(False))
    return _removal(lambda x: equal(x, literal(arg)))


def _pull_all(arg: object, ctx: Context) -> Change:
    if not isinstance(arg, (list, tuple)):
        raise BadValue("$pullAll needs an array")

    def test(x: Typed) -> Column:
        out = F.lit(False)
        for item in arg:
            out = out | F.coalesce(equal(x, literal(item)), F.lit(False))
        return out

    return _removal(test)


def _pop(arg: object, ctx: Context) -> Change:
    if isinstance(arg, bool) or not isinstance(arg, (int, float)):
        raise BadValue("$pop takes 1 or -1")

    def change(old: Typed) -> Typed:
        if old.missing or old.null:
            return old
        if not isinstance(old.kind, T.ArrayType):
            raise BadValue("the field holds no array")
        rest = F.greatest(F.size(old.col) - 1, F.lit(0))
        return Typed(F.slice(old.col, F.lit(1) if arg >= 1 else F.lit(2), rest), old.kind)

    return change


CHANGES = {
    "$set": _set, "$unset": _unset, "$inc": _arithmetic(lambda a, b: a + b), "$mul": _arithmetic(lambda a, b: a * b), "$min": _bound(lambda old, new: less(new, old)),
    "$max": _bound(lambda old, new: less(old, new)), "$currentDate": _current_date, "$bit": _bit, "$push": _push, "$addToSet": _add_to_set, "$pull": _pull, "$pullAll": _pull_all, "$pop": _pop,
}
PIPELINE = {"$addFields", "$set", "$project", "$unset", "$replaceRoot", "$replaceWith"}


def apply_update(frame: Frame, update: dict | list, query: dict | None = None, array_filters: list[dict] | None = None, inserting: bool = False) -> Frame:
    """The frame with all its documents updated. The identifier stays as it is.

    A removed top-level field leaves the frame's schema; a caller that updates some rows alone fills it with nulls.
    """
    if isinstance(update, (list, tuple)):
        return _by_pipeline(frame, update)
    if not update or not all(k.startswith("$") for k in update):
        raise BadValue("an update is operators or a pipeline; a whole document replaces by replace_one")
    ctx = Context(query or {}, parse_array_filters(array_filters, update), frame.now)
    fields = {f.name: Typed(quoted(f.name), f.dataType, frame.plain) for f in frame.df.schema}
    for op, spec in update.items():
        if op not in CHANGES and op not in ("$rename", "$setOnInsert"):
            raise BadValue(f"unknown update operator {op}")
        if not isinstance(spec, dict):
            raise BadValue(f"{op} needs fields")
        for path, arg in spec.items():
            segments = path.split(".")
            if not all(segments):
                raise BadValue(f"an empty part in the path {path!r}")
            if segments[0] in ("_id", frame.id_col):
                continue
            if op == "$rename":
                _rename(fields, path, arg, ctx)
            elif op != "$setOnInsert" or inserting:
                change = CHANGES["$set" if op == "$setOnInsert" else op](arg, ctx)
                new = modify(fields.get(segments[0], MISSING), segments[1:], change, ctx, (segments[0],))
                fields.pop(segments[0], None) if new.missing else fields.update({segments[0]: new})
    return frame.with_df(frame.df.select(*[v.col.alias(n) for n, v in fields.items()]))


def _rename(fields: dict[str, Typed], path: str, to: object, ctx: Context) -> None:
    if not isinstance(to, str) or not to or to == path:
        raise BadValue("$rename needs another name")
    held = MISSING
    at = fields.get(path.split(".")[0], MISSING)
    for name in path.split(".")[1:]:
        if not at.missing and isinstance(at.kind, T.ArrayType):
            raise BadValue("$rename does not reach into arrays")
        at = Typed(at.col.getField(name), at.kind[name].dataType) if not at.missing and isinstance(at.kind, T.StructType) and name in at.kind.fieldNames() else MISSING
    held = at
    if held.missing:
        return
    for target, change in ((path, _unset(None, ctx)), (to, lambda old: held)):
        first, *rest = target.split(".")
        new = modify(fields.get(first, MISSING), rest, change, ctx, (first,))
        fields.pop(first, None) if new.missing else fields.update({first: new})


def _by_pipeline(frame: Frame, stages: list[dict]) -> Frame:
    for one in stages:
        if not isinstance(one, dict) or len(one) != 1 or next(iter(one)) not in PIPELINE:
            raise BadValue("an update pipeline sets, projects, unsets or replaces")
    ident, own = frame.id_col, [c for c in frame.df.columns if c.startswith("__")]
    kept = frame
    if ident:  # the identifier can't be changed, and comes back if a stage drops it
        kept, own = frame.with_df(frame.df.withColumn("__id", quoted(ident))), [*own, "__id"]
    for one in stages:
        name, spec = next(iter(one.items()))
        if name in ("$replaceRoot", "$replaceWith"):
            root = spec["newRoot"] if name == "$replaceRoot" else spec
            v = compile_expr(root, kept.env())
            if v.missing or not isinstance(v.kind, T.StructType):
                raise BadValue("a new root is a document")
            there = F.when(v.col.isNotNull(), v.col).otherwise(F.raise_error(F.lit("a new root is a document, not null")))
            held = kept.df.withColumn("__root", there)
            names = [n for n in v.kind.fieldNames() if n != ident]
            kept = kept.with_df(held.select(*own, *([F.col("__id").alias(ident)] if ident else []), *[F.col("__root").getField(n).alias(n) for n in names]))
        elif name == "$project":
            more = dict.fromkeys(own, 1) if any(not projection.excludes(v) for k, v in spec.items() if k not in ("_id", ident)) else {}
            kept = kept.with_df(run_pipeline(kept, [{"$project": spec | more}]).df)
        else:
            kept = kept.with_df(run_pipeline(kept, [one]).df)
    names = [n for n in kept.df.columns if n not in (ident, "__id")]
    return replace(frame, df=kept.df.select(*([F.col("__id").alias(ident)] if ident else []), *[quoted(n) for n in names]))


def update_rows(frame: Frame, match: Column, update: dict | list, query: dict | None = None, array_filters: list[dict] | None = None) -> tuple[Frame, Column]:
    """The frame with matching rows updated, and its last column, `__changed`: whether a row is another document now."""
    target = F.coalesce(match, F.lit(False))
    before = frame.df.schema
    # Old values stay beside the new ones until each row takes one of them.
    joined = apply_update(frame.with_df(frame.df.select("*", target.alias("__match"), F.struct(*[quoted(f.name).alias(f.name) for f in before]).alias("__old"))), update, query, array_filters).df
    schema = joined.schema
    out, changed = [], F.lit(False)
    for name in dict.fromkeys([*before.fieldNames(), *schema.fieldNames()]):
        if name in ("__match", "__old"):
            continue
        old = Typed(F.col("__old").getField(name), before[name].dataType) if name in before.fieldNames() else null()
        new = Typed(quoted(name), schema[name].dataType) if name in schema.fieldNames() else null()
        kind = unify([old.kind, new.kind])
        x, y = cast(old, kind), cast(new, kind)
        out.append(F.when(F.col("__match"), y).otherwise(x).alias(name))
        changed = changed | ~x.eqNullSafe(y)
    return frame.with_df(joined.select(*out, (F.col("__match") & changed).alias("__changed"))), F.col("__changed")


def upsert_base(query: dict) -> dict:
    """The equality conditions of a filter as a document; $and and operators give nothing."""
    out: dict = {}
    for key, arg in query.items():
        if not key.startswith("$") and not is_operators(arg):
            at = out
            *parents, last = key.split(".")
            for p in parents:
                at = at.setdefault(p, {}) if isinstance(at.get(p, {}), dict) else {}
            at[last] = arg
    return out
