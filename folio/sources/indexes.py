"""Index metadata: names, uniqueness, partial and sparse coverage, expiry. Scans are planned by Spark, not by these."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue, CannotCreateIndex, DuplicateKey
from ..operators.filters import compile_filter
from ..operators.frame import Frame
from ..types import DATES, literal


@dataclass(frozen=True)
class Index:
    keys: tuple[tuple[str, int], ...]
    name: str
    unique: bool = False
    sparse: bool = False
    partial: dict | None = None
    expire_after: int | None = None

    def info(self) -> dict:
        out = {"v": 2, "key": dict(self.keys), "name": self.name}
        more = {"unique": self.unique or None, "sparse": self.sparse or None, "partialFilterExpression": self.partial, "expireAfterSeconds": self.expire_after}
        return out | {k: v for k, v in more.items() if v is not None}

    def as_meta(self) -> dict:
        return asdict(self)

    @classmethod
    def of_meta(cls, meta: dict) -> Index:
        return cls(**meta | {"keys": tuple((k, d) for k, d in meta["keys"])})


def make(keys: dict, id_col: str | None, name: str | None = None, unique: bool = False, sparse: bool = False, partial: dict | None = None, expire_after: int | None = None) -> Index:
    """A checked index."""
    if not keys:
        raise CannotCreateIndex("an index needs keys")
    for path, kind in keys.items():
        if isinstance(kind, str):
            raise CannotCreateIndex(f"{kind} indexes are not supported")
        if isinstance(kind, bool) or kind not in (1, -1) or not path or path.startswith("$"):
            raise CannotCreateIndex("an index key is a field and a direction")
    on_id = set(keys) <= {"_id", id_col}
    if partial is not None and (sparse or on_id or not partial):
        raise CannotCreateIndex("a partial index has a filter, is not sparse and not on the identifier")
    if expire_after is not None and (len(keys) != 1 or on_id or isinstance(expire_after, bool) or expire_after < 0):
        raise CannotCreateIndex("an expiring index has one field, not the identifier, and a time from 0 on")
    return Index(tuple((k, int(d)) for k, d in keys.items()), name or "_".join(f"{k}_{int(d)}" for k, d in keys.items()), unique, sparse, partial, expire_after)


def check_unique(frame: Frame, index: Index) -> None:
    """Raise where two documents share a key. An array has a key for each element, and none if it is empty."""
    env, df = frame.env(), frame.df
    if index.partial is not None:
        df = df.where(compile_filter(index.partial, env))
    values = [env.field(path) for path, _ in index.keys]
    if index.sparse and any(v.missing for v in values):
        return
    if index.sparse and frame.plain:
        for v in values:
            df = df.where(v.col.isNotNull())
    arrays = [v for v in values if not v.missing and isinstance(v.kind, T.ArrayType)]
    if len(arrays) > 1:
        raise CannotCreateIndex("an index has one array at most")
    cols = []
    for i, v in enumerate(values):
        if v in arrays:
            distinct = F.when(v.col.isNull(), F.array(F.lit(None).cast(v.kind.elementType))).otherwise(F.array_distinct(v.col))
            cols.append(F.explode(distinct).alias(f"k{i}"))
        else:
            cols.append((F.lit(None).cast("string") if v.missing else v.col).alias(f"k{i}"))
    names = [f"k{i}" for i in range(len(values))]
    twice = df.select(*cols).groupBy(*names).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKey(f"duplicate key of index {index.name}: {tuple(twice[0][n] for n in names)!r}")


def expired(frame: Frame, index: Index, now: dt.datetime) -> Column:
    """Whether a document's time has run out: its date, or any date of its array, lies before the limit."""
    if index.expire_after is None:
        raise BadValue(f"index {index.name} does not expire")
    v = frame.env().field(index.keys[0][0])
    limit = literal(now - dt.timedelta(seconds=index.expire_after)).col
    if v.missing:
        return F.lit(False)
    if isinstance(v.kind, DATES):
        old = v.col.cast("timestamp") < limit
    elif isinstance(v.kind, T.ArrayType) and isinstance(v.kind.elementType, DATES):
        old = F.exists(v.col, lambda x: x.cast("timestamp") < limit)
    else:
        return F.lit(False)
    within = compile_filter(index.partial, frame.env()) if index.partial is not None else F.lit(True)
    return F.coalesce(old & within, F.lit(False))


def sweep(frame: Frame, indexes: list[Index], now: dt.datetime | None = None) -> DataFrame:
    """The documents that no expiring index has run out for."""
    now = now or frame.now
    df = frame.df
    for index in indexes:
        if index.expire_after is not None:
            df = df.where(~expired(frame, index, now))
    return df
