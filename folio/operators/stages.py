"""Stages of a pipeline as DataFrame operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue
from ..functions.expr import compile_expr
from ..paths import Env, quoted
from ..plans.pipeline import Stage, parse, rewrite
from ..types import Typed, cast, family, unify
from . import projection
from .accumulators import Bounded, bounded, compile_accumulator
from .filters import compile_filter
from .frame import Fields, Frame


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def run_pipeline(frame: Frame, pipeline: list[dict]) -> Frame:
    """The frame after all stages."""
    stages = rewrite(parse(pipeline))
    for i, stage in enumerate(stages):
        follows = stages[i + 1].name if i + 1 < len(stages) else None
        frame = _sort(frame, stage.spec, follows) if stage.name == "$sort" else RUN[stage.name](frame, stage)
    return frame


def _match(frame: Frame, stage: Stage) -> Frame:
    return frame.with_df(frame.df.where(compile_filter(stage.spec, frame.env())))


def _sort(frame: Frame, keys: tuple[tuple[str, int], ...], follows: str | None = None) -> Frame:
    """Sort, ties by identifier. Before a stage that orders explicitly or not at all, only the order is noted."""
    frame = replace(frame, order=keys)
    if follows in ("$group", "$sortByCount", "$count", "$sort"):
        return frame
    return frame.with_df(frame.df.orderBy(*frame.sort_columns()))


def _skip(frame: Frame, stage: Stage) -> Frame:
    return _in_order(frame).with_df(_in_order(frame).df.offset(stage.spec))


def _limit(frame: Frame, stage: Stage) -> Frame:
    ordered = _in_order(frame)
    return ordered.with_df(ordered.df.limit(stage.spec))


def _in_order(frame: Frame) -> Frame:
    """Without a sort, documents come in the order of their identifier."""
    if frame.order or frame.id_col not in frame.df.columns:
        return frame
    return _sort(frame, ((frame.id_col, 1),))


def _count(frame: Frame, stage: Stage) -> Frame:
    return frame.with_df(frame.df.agg(F.count(F.lit(1)).alias(stage.spec)), id_col=None, order=())


def _project(frame: Frame, stage: Stage) -> Frame:
    flags = {k: v for k, v in stage.spec.items() if isinstance(v, (bool, int, float))}
    computed = {k: v for k, v in stage.spec.items() if k not in flags}
    if not computed:
        return _order_kept(projection.apply(frame, flags))
    env = frame.env()
    base = flags if any(k not in ("_id", frame.id_col) for k in flags) else flags | {"__none": 1}
    start = projection.apply(frame, base)
    out = Fields(frame, start.df.columns)
    for name in start.df.columns:  # nested inclusion is computed from the whole document
        if start.df.schema[name].dataType != frame.df.schema[name].dataType:
            spec = projection.tree([k for k in flags if k not in ("_id", frame.id_col)])
            out.values[name] = projection.project(out.values[name], spec[name], not projection.excludes(next(v for k, v in flags.items() if k.split(".")[0] == name)))
    for path, e in computed.items():
        out.set(path, compile_expr(e, env))
    return _order_kept(out.done(id_col=start.id_col))


def _order_kept(frame: Frame) -> Frame:
    """Drop from the noted order what the documents no longer have."""
    kept = []
    for path, direction in frame.order:
        if frame.env().field(path).missing:
            break
        kept.append((path, direction))
    return replace(frame, order=tuple(kept))


def add_fields(frame: Frame, spec: dict) -> Frame:
    """All expressions see the documents as they were."""
    env, out = frame.env(), Fields(frame)
    for path, e in spec.items():
        out.set(path, compile_expr(e, env))
    return out.done()


def _unset(frame: Frame, stage: Stage) -> Frame:
    return _order_kept(projection.apply(frame, dict.fromkeys(stage.spec, 0)))


def replace_root(frame: Frame, e: object) -> Frame:
    v = compile_expr(e, frame.env())
    if v.missing or v.null or not isinstance(v.kind, T.StructType):
        raise BadValue("a new root is a document")
    there = F.when(v.col.isNotNull(), v.col).otherwise(F.raise_error(F.lit("a new root is a document, not null")))
    df = frame.df.select(there.alias("__root")).select("__root.*")
    id_col = "_id" if "_id" in df.columns else frame.id_col if frame.id_col in df.columns else None
    return _order_kept(frame.with_df(df, id_col=id_col))


def _unwind(frame: Frame, stage: Stage) -> Frame:
    path, keep, index = stage.spec["path"], stage.spec["keep"], stage.spec["index"]
    v = frame.env().field(path)
    df, at, held = frame.df, fresh("__at", frame.df.columns), fresh("__item", frame.df.columns)
    if v.missing:
        return frame if keep and not index else frame.with_df(df.withColumn(index, F.lit(None).cast("bigint")) if keep else df.where(F.lit(False)))
    if isinstance(v.kind, T.ArrayType):
        made = F.posexplode_outer(v.col) if keep else F.posexplode(v.col)
        df = df.select("*", made.alias(at, held))
        value, place = Typed(F.col(held), v.kind.elementType, frame.plain), F.col(at).cast("bigint")
    else:
        df = (df if keep else df.where(v.col.isNotNull())).withColumns({held: v.col, at: F.lit(None).cast("bigint")})
        value, place = Typed(F.col(held), v.kind, frame.plain), F.col(at)
    wide = frame.with_df(df)
    out = Fields(wide, frame.df.columns)
    out.set(path, value)
    if index:
        out.set(index, Typed(place, T.LongType()))
    return out.done()


def _group(frame: Frame, stage: Stage) -> Frame:
    spec = dict(stage.spec)
    key = compile_expr(spec.pop("_id"), frame.env())
    # A stream has no ranks over all its rows, so there a group's values are collected.
    ranked = {} if frame.df.isStreaming else {name: b for name, one in spec.items() if (b := bounded(one, frame))}
    made = {name: compile_accumulator(name, one, frame) for name, one in spec.items() if name not in ranked}
    aggs = [c.alias(name) for name, (c, _) in made.items()]
    single = key.missing or key.null or key.constant is not None
    if single:
        # One group, or none where there are no documents.
        one = frame.df.agg(*aggs, F.count(F.lit(1)).alias("__n")).where("__n > 0")
        value = F.lit(None).cast("string") if key.missing or key.null else key.col
        df = one.select(value.alias("_id"), *[quoted(n) for n in made])
    else:
        df = frame.df.groupBy(key.col.alias("_id")).agg(*aggs) if aggs else frame.df.select(key.col.alias("_id")).distinct()
    for name, one in ranked.items():
        df = _with_ranked(df, frame, None if single else key.col, name, one)
    return frame.with_df(df.select("_id", *[quoted(n) for n in spec]), id_col="_id", order=())


def _with_ranked(groups: DataFrame, frame: Frame, key: Column | None, name: str, one: Bounded) -> DataFrame:
    """The groups with the field of an accumulator of n values. Each partition passes on no more than n rows a group, so
    no group is ever held in one row or task."""
    rows = (frame.df if one.there is None else frame.df.where(one.there)).select(*([] if key is None else [key.alias("g")]), one.at.alias("at"), one.value.col.alias("x"))
    by = F.col("at").desc() if one.falling else F.col("at").asc()
    if key is None:
        top = rows.orderBy(by).limit(one.n)
    else:
        top = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(by))).where(F.col("r") <= one.n)
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"])
    at = fresh("values", groups.columns)
    values = (F.reverse(values) if one.turned else values).alias(at)
    held = T.ArrayType(one.value.kind)
    if key is None:  # one row meets one row
        met = groups.join(F.broadcast(top.agg(values)), how="cross")
    else:
        listed = top.groupBy("g").agg(values)
        met = groups.join(listed, groups["_id"].eqNullSafe(listed["g"]), "left")
    return met.select(*[groups[f"`{c}`"] for c in groups.columns], F.coalesce(F.col(at), F.array().cast(held)).alias(name))


def _sort_by_count(frame: Frame, stage: Stage) -> Frame:
    counted = _group(frame, Stage("$group", {"_id": stage.spec, "count": {"$count": {}}}))
    return _sort(counted, (("count", -1),))


def _lookup(frame: Frame, stage: Stage) -> Frame:
    spec, notes = stage.spec, stage.notes
    other = frame.foreign(spec["from"])
    how = notes.get("join")
    if other is None:
        if how in ("inner", "semi"):
            return frame.with_df(frame.df.where(F.lit(False)))
        if how in ("anti", "left"):
            return frame
        out = Fields(frame)
        out.set(spec["as"], Typed(F.array().cast("array<string>"), T.ArrayType(T.StringType())))
        return out.done()
    local = frame.env().field(spec["localField"])
    far = Env(other.schema, frame.now, frame.plain).field(spec["foreignField"])
    used = notes.get("used")
    names = [n for n in other.columns if used is None or n in used]
    doc = F.struct(*[quoted(n).alias(n) for n in names]) if names else F.struct(F.lit(None).cast("string").alias("__"))
    arrays = any(isinstance(v.kind, T.ArrayType) for v in (local, far) if not v.missing)
    if arrays:
        return _lookup_arrays(frame, stage, other, local, far, doc)
    if _comparable(local, far):
        kind = unify([v.as_null().kind for v in (local, far)])
        kind = T.IntegerType() if isinstance(kind, T.NullType) else kind
    else:  # values of different types are never equal, nulls are
        kind = T.IntegerType()
        local, far = (Typed(F.when(v.col.isNotNull(), F.lit(side)), kind) for side, v in enumerate((local, far)))
    key, held = (fresh(n, frame.df.columns) for n in ("__key", "__doc"))
    build = other.select(cast(far, kind).alias(key), doc.alias(held))
    left = frame.df.select("*", cast(local, kind).alias(key))
    # Where documents have no nulls, the plain equality lets Spark prune and spread the join.
    same = lambda right: left[key] == right[key] if frame.plain else left[key].eqNullSafe(right[key])
    if how in ("semi", "anti"):
        return frame.with_df(left.join(build, same(build), f"left_{how}").drop(key))
    doc_kind = build.schema[held].dataType
    if how in ("inner", "left"):
        joined = left.join(build, same(build), how)
        value = Typed(joined[held], doc_kind, frame.plain)
    else:
        sets = build.groupBy(key).agg(F.array_sort(F.collect_list(held)).alias(held))
        joined = left.join(sets, same(sets), "left")
        value = Typed(F.coalesce(joined[held], F.array().cast(T.ArrayType(doc_kind))), T.ArrayType(doc_kind), frame.plain)
    kept = joined.select(*[left[f"`{n}`"] for n in frame.df.columns], value.col.alias(held))
    out = Fields(frame.with_df(kept), frame.df.columns)
    out.set(spec["as"], Typed(F.col(held), value.kind, frame.plain))
    return out.done()


def _comparable(a: Typed, b: Typed) -> bool:
    return any(v.missing or v.null for v in (a, b)) or family(a.kind) == family(b.kind)


def _exploded(v: Typed, kind: T.DataType) -> Column:
    """The keys a value joins by: an array's elements, the value itself, and one for a null or missing value."""
    if v.missing or v.null:
        return F.array(F.struct(F.lit(False).alias("empty"), F.lit(None).cast(kind).alias("v")))
    if not isinstance(v.kind, T.ArrayType):
        return F.array(F.struct(F.lit(False).alias("empty"), cast(v, kind).alias("v")))
    none = F.array(F.struct(F.lit(False).alias("empty"), F.lit(None).cast(kind).alias("v")))
    # An empty array is a value of its own, equal to another empty array alone.
    empty = F.array(F.struct(F.lit(True).alias("empty"), F.lit(None).cast(kind).alias("v")))
    each = F.transform(F.array_distinct(v.col), lambda x: F.struct(F.lit(False).alias("empty"), cast(Typed(x, v.kind.elementType), kind).alias("v")))
    return F.when(v.col.isNull(), none).when(F.size(v.col) == 0, empty).otherwise(each)


def _lookup_arrays(frame: Frame, stage: Stage, other: DataFrame, local: Typed, far: Typed, doc: Column) -> Frame:
    spec, how = stage.spec, stage.notes.get("join")
    inner = [v.kind.elementType if isinstance(v.kind, T.ArrayType) else v.kind for v in (local.as_null(), far.as_null())]
    try:
        kind = unify(inner)
    except BadValue:
        return _lookup(frame, Stage("$lookup", spec | {"foreignField": "\0none"}, stage.notes))
    kind = T.StringType() if isinstance(kind, T.NullType) else kind
    key, keys, item = (fresh(n, frame.df.columns) for n in ("__key", "__keys", "__doc"))
    right = other.select(F.explode(_exploded(far, kind)).alias(key), doc.alias(item))
    # Each distinct set of local keys is joined once; its documents come back to the rows by that set.
    sets = frame.df.select(_exploded(local, kind).alias(keys)).distinct()
    pairs = sets.select(keys, F.explode(keys).alias(key)).join(right, key).select(keys, item).distinct()
    found = pairs.groupBy(keys).agg(F.array_sort(F.collect_list(item)).alias(item))
    left = frame.df.select("*", _exploded(local, kind).alias(keys))
    if how in ("semi", "anti"):
        return frame.with_df(left.join(found, keys, f"left_{how}").drop(keys))
    joined = left.join(found, keys, "left").drop(keys)
    held = found.schema[item].dataType
    value = Typed(F.coalesce(F.col(item), F.array().cast(held)), held, frame.plain)
    out = Fields(frame.with_df(joined), frame.df.columns)
    out.set(spec["as"], value)
    done = out.done()
    if how:
        done = _unwind(done, Stage("$unwind", {"path": spec["as"], "keep": how == "left", "index": None}))
    return done


RUN = {
    "$match": _match, "$skip": _skip, "$limit": _limit, "$count": _count, "$project": _project, "$addFields": lambda f, s: add_fields(f, s.spec), "$unset": _unset,
    "$replaceRoot": lambda f, s: replace_root(f, s.spec), "$unwind": _unwind, "$group": _group, "$sortByCount": _sort_by_count, "$lookup": _lookup,
}
