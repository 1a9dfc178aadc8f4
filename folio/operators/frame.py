"""What a pipeline works on: a DataFrame, its identifier, and the order its documents are in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedOperator
from ..order import sort_keys
from ..paths import Env, assign, quoted
from ..types import FLOATS, MISSING, Typed, alias


def utc_now() -> dt.datetime:
    """Now, to the millisecond that documents keep."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    id_col: str | None = None
    order: tuple[tuple[str, int], ...] = ()
    plain: bool = False
    now: dt.datetime = field(default_factory=utc_now)
    foreign: Callable[[str], DataFrame | None] = lambda name: None

    def env(self) -> Env:
        return Env(self.df.schema, self.now, self.plain, id_col=self.id_col)

    def with_df(self, df: DataFrame, **changes: object) -> Frame:
        return replace(self, df=df, **changes)

    def ordering(self) -> list[tuple[Typed, int]]:
        """The sort in force, then the identifier; without one, every column that can be ordered."""
        env = self.env()
        keys = [(v, d) for path, d in self.order if not (v := env.field(path)).missing and not v.null]
        if self.id_col in self.df.columns:
            return keys + [(Typed(quoted(self.id_col), self.df.schema[self.id_col].dataType, self.plain), 1)]
        return keys + [(Typed(quoted(f.name), f.dataType, self.plain), 1) for f in self.df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]

    def sort_columns(self) -> list[Column]:
        return [c for v, d in self.ordering() for c in sort_keys(v, d)]

    def place(self) -> Column:
        """A value whose natural order is the documents' order."""
        return F.struct(*[rising(v, d).alias(f"k{i}") for i, (v, d) in enumerate(self.ordering())])


def rising(v: Typed, direction: int) -> Column:
    """A column whose natural order is v's canonical order in the direction."""
    x = v.col
    if direction > 0:
        return F.struct(F.when(x.isNull(), 0).when(F.isnan(x), 1).otherwise(2).alias("c"), x.alias("v")) if v.nan else x
    if isinstance(v.kind, (T.ArrayType, T.StructType, T.BinaryType)):
        raise UnsupportedOperator(f"falling order of {alias(v.kind)} values in an accumulator")
    if isinstance(v.kind, T.StringType):
        # Hex digits turned over; G is above all of them, so that a prefix comes behind what it begins.
        turned = F.concat(F.translate(F.hex(x), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    elif isinstance(v.kind, T.BooleanType):
        turned = -x.cast("int")
    elif isinstance(v.kind, (*FLOATS, T.DecimalType)):
        turned = -x
    else:
        turned = -(x.cast("bigint") if not isinstance(v.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.unix_micros(x.cast("timestamp")))
    last = F.when(x.isNull(), 2).otherwise(F.when(F.isnan(x), 1).otherwise(0) if v.nan else 0)
    return F.struct(last.alias("c"), turned.alias("v"))


class Fields:
    """The top level of a document under construction."""

    def __init__(self, frame: Frame, names: list[str] | None = None) -> None:
        self.frame = frame
        self.values = {f.name: Typed(quoted(f.name), f.dataType, frame.plain) for f in frame.df.schema if names is None or f.name in names}

    def name(self, first: str) -> str:
        return self.frame.id_col if first == "_id" and self.frame.id_col and "_id" not in self.frame.df.columns else first

    def set(self, path: str, value: Typed) -> None:
        """Put a value at a dotted path; a missing one changes nothing."""
        first, *rest = path.split(".")
        if not value.missing:
            first = self.name(first)
            held = self.values.get(first, MISSING)
            self.values[first] = assign(held, rest, value) if rest else value

    def done(self, **changes: object) -> Frame:
        df = self.frame.df.select(*[v.col.alias(n) for n, v in self.values.items()])
        return self.frame.with_df(df, **changes)
