"""Documents of mixed types, each a Variant.

A field may hold numbers here and strings there, and be missing in one document and null in the next. Two Arrow
functions carry the semantics that Variants lack: a binary key whose byte order is the canonical order of values, and
equality through it. Frames of one type a column never come here.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .errors import BadValue, UnsupportedOperator
from .operators.filters import BACKTRACKING
from .types import RANK

#: A missing value sorts and groups with null, and equals it in filters.
MISSING = object()


def _number(x: float | int) -> bytes:
    """8 bytes that order as doubles do, NaN first; then what the double has lost of a long integer."""
    d = float(x)
    if math.isnan(d):
        return b"\0" * 10
    bits = struct.unpack(">Q", struct.pack(">d", d + 0.0))[0]
    bits = bits ^ (2**64 - 1) if bits >> 63 else bits | 1 << 63
    rest = int(x) - int(d) if isinstance(x, int) and abs(d) < 1e300 else 0
    return struct.pack(">Qh", bits, max(-(2**15), min(2**15 - 1, rest)))


def sort_key(value: object) -> bytes:
    """Bytes in canonical order: type class, then value. Documents compare field by field, type before name before value."""
    if value is None or value is MISSING:
        return bytes([RANK["null"]])
    if isinstance(value, bool):
        return bytes([RANK["bool"], value])
    if isinstance(value, (int, float)):
        return bytes([RANK["number"]]) + _number(value)
    if isinstance(value, str):
        return bytes([RANK["string"]]) + value.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    if isinstance(value, dict):
        parts = [(k := sort_key(v))[:1] + name.encode().replace(b"\0", b"\0\xff") + b"\0\0" + k[1:] for name, v in value.items()]
        return bytes([RANK["object"]]) + b"".join(parts) + b"\0"
    if isinstance(value, (list, tuple)):
        return bytes([RANK["array"]]) + b"".join(map(sort_key, value)) + b"\0"
    raise BadValue(f"no document value: {type(value).__name__}")


def walk(doc: object, path: str) -> object:
    """The value at a dotted path: through documents, and into an array by a last index."""
    parts = path.split(".")
    for i, name in enumerate(parts):
        if isinstance(doc, dict):
            if name not in doc:
                return MISSING
            doc = doc[name]
        elif isinstance(doc, list) and i == len(parts) - 1 and name.isdigit():
            return doc[int(name)] if int(name) < len(doc) else MISSING
        else:
            return MISSING
    return doc


def _order(a: object, b: object) -> int:
    x, y = sort_key(a), sort_key(b)
    return (x > y) - (x < y)


def matches(doc: dict, query: dict) -> bool:
    """A filter on one document; the two-valued rules that typed filters compile to."""
    for key, arg in query.items():
        if key == "$and":
            ok = all(matches(doc, q) for q in arg)
        elif key in ("$or", "$nor"):
            if not arg:
                raise BadValue(f"{key} needs filters")
            ok = any(matches(doc, q) for q in arg) == (key == "$or")
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise UnsupportedOperator(f"unsupported filter {key}")
        else:
            ok = _holds(walk(doc, key), arg)
        if not ok:
            return False
    return True


def _holds(v: object, arg: object) -> bool:
    if not (isinstance(arg, dict) and any(k.startswith("$") for k in arg)):
        return _equals(v, arg)
    if "$regex" in arg:
        flags = arg.get("$options", "")
        if set(flags) - set("imsxlu"):
            raise BadValue(f"unknown $options {flags!r}")
        named = "".join(sorted(set(flags) & set("imsx")))
        # Without m, $ is the very end of the text.
        body = arg["$regex"] if "m" in flags else re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\$", lambda m: r"\Z" if m[0] == "$" else m[0], arg["$regex"])
        arg = {k: x for k, x in arg.items() if k != "$options"} | {"$regex": f"(?{named}){body}" if named else body}
    return all(_operator(v, op, x) for op, x in arg.items())


def _any(v: object, test) -> bool:
    return test(v) or isinstance(v, list) and any(map(test, v))


def _equals(v: object, want: object) -> bool:
    return _any(v, lambda x: _order(x, want) == 0)


def _operator(v: object, op: str, arg: object) -> bool:
    comparisons = {"$gt": lambda c: c > 0, "$gte": lambda c: c >= 0, "$lt": lambda c: c < 0, "$lte": lambda c: c <= 0}
    if op in comparisons:
        return v is not MISSING and (any(comparisons[op](_order(x, arg)) for x in v) if isinstance(v, list) and not isinstance(arg, list) else comparisons[op](_order(v, arg)))
    if op == "$eq":
        return _equals(v, arg)
    if op == "$ne":
        return not _equals(v, arg)
    if op in ("$in", "$nin"):
        return any(_equals(v, x) for x in arg) == (op == "$in")
    if op == "$exists":
        return (v is not MISSING) == bool(arg)
    if op == "$not":
        return not _holds(v, arg)
    if op == "$size":
        return isinstance(v, list) and len(v) == arg
    if op == "$all":
        return bool(arg) and v is not MISSING and all(_equals(v, x) for x in arg)
    if op == "$elemMatch":
        return isinstance(v, list) and any(_holds(x, arg) if any(k.startswith("$") for k in arg) else isinstance(x, dict) and matches(x, arg) for x in v)
    if op == "$type":
        return type_name(v) in (arg if isinstance(arg, list) else [arg])
    if op == "$mod":
        by, rest = (int(x) for x in arg)
        return _any(v, lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and int(math.fmod(int(x), by)) == rest)
    if op == "$regex":
        if BACKTRACKING.search(arg):
            raise BadValue("look-around, back references and possessive repetition are not supported")
        return _any(v, lambda x: isinstance(x, str) and re.search(arg, x) is not None)
    raise UnsupportedOperator(f"unsupported filter {op} on documents of mixed types")


def type_name(v: object) -> str:
    if v is MISSING:
        return "missing"
    for kinds, name in ((type(None), "null"), (bool, "bool"), (float, "double"), (str, "string"), (dict, "object"), (list, "array")):
        if isinstance(v, kinds):
            return name
    return "int" if -(2**31) <= v < 2**31 else "long"


class Documents:
    """A DataFrame with one Variant column `doc`; filter, sort, group and distinct over fields of mixed types."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.select(F.col(df.columns[0]).alias("doc"))

    @classmethod
    def of_json(cls, df: DataFrame, column: str) -> Documents:
        return cls(df.select(F.parse_json(column).alias("doc")))

    def _key(self, path: str) -> Column:
        @pandas_udf("binary")
        def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: sort_key(walk(json.loads(t), path)))

        return key(F.to_json("doc"))

    def match(self, query: dict) -> Documents:
        matches({}, query)  # what is unsupported shows before the query runs

        @pandas_udf("boolean")
        def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: matches(json.loads(t), query))

        return Documents(self.df.where(test(F.to_json("doc"))))

    def sort(self, keys: dict[str, int]) -> Documents:
        return Documents(self.df.orderBy(*[self._key(p).asc() if d > 0 else self._key(p).desc() for p, d in keys.items()]))

    def field(self, path: str) -> Column:
        """The value at the path as a Variant; SQL NULL where it is missing."""
        at = "$" + "".join(f"[{p}]" if p.isdigit() else "." + p for p in path.split("."))
        return F.try_variant_get("doc", at, "variant")

    def group(self, path: str) -> DataFrame:
        """(_id as JSON, count) of each value in canonical equality: 1 and 1.0 are one group, null and missing too."""
        keyed = self.df.select(self._key(path).alias("k"), F.coalesce(F.to_json(self.field(path)), F.lit("null")).alias("v"))
        return keyed.groupBy("k").agg(F.min("v").alias("_id"), F.count(F.lit(1)).alias("count")).select("_id", "count")

    def distinct(self, path: str) -> DataFrame:
        """The distinct values at the path as JSON; a missing one contributes nothing."""
        there = self.df.select(self._key(path).alias("k"), self.field(path).alias("v")).where("v is not null")
        return there.groupBy("k").agg(F.min(F.to_json("v")).alias("value")).select("value")

    def to_list(self) -> list[dict]:
        return [json.loads(r[0]) for r in self.df.select(F.to_json("doc")).toLocalIterator()]
