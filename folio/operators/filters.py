"""Filters compiled to predicates.

A predicate may be null where it is not true; it is made two-valued where it is negated. Conditions on a bare column
stay bare comparisons with literals, which Spark pushes down to the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue, UnsupportedOperator
from ..functions.expr import condition
from ..order import equal, less
from ..paths import Env
from ..types import FLOATS, TYPE_IDS, Typed, alias, family, is_number, literal

Pattern = type(re.compile(""))
#: Constructs of the pattern language that only backtracking engines have.
BACKTRACKING = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+)")


def negate(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def compile_filter(spec: dict, env: Env) -> Column:
    """The predicate of a filter document."""
    if not isinstance(spec, dict):
        raise BadValue("a filter is a document")
    parts = []
    for key, arg in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts.append(_logical(key, arg, env))
        elif key == "$expr":
            parts.append(condition(arg, env))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise UnsupportedOperator(f"unsupported filter {key}") if key != "$not" else BadValue("$not stands below a field")
        else:
            parts.append(_field(env.field(key), arg))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def _logical(key: str, arg: object, env: Env) -> Column:
    if not isinstance(arg, (list, tuple)) or not arg and key != "$and":
        raise BadValue(f"{key} needs an array of filters")
    parts = [compile_filter(x, env) for x in arg]
    if key == "$and":
        return reduce(Column.__and__, parts, F.lit(True)) if parts else F.lit(True)
    either = reduce(Column.__or__, parts)
    return either if key == "$or" else negate(either)


def is_operators(arg: object) -> bool:
    return isinstance(arg, dict) and any(k.startswith("$") for k in arg)


def _field(v: Typed, arg: object) -> Column:
    if isinstance(arg, Pattern):
        return _regex(v, arg, "")
    return conditions(v, arg) if is_operators(arg) else _eq(v, literal(arg))


def conditions(v: Typed, spec: dict) -> Column:
    """All operators of an operator document on one value."""
    if not all(k.startswith("$") for k in spec):
        raise BadValue("operators and fields are mixed")
    if "$options" in spec and "$regex" not in spec:
        raise BadValue("$options needs $regex")
    parts = []
    for op, arg in spec.items():
        if op == "$options":
            continue
        if op == "$regex":
            parts.append(_regex(v, arg, spec.get("$options", "")))
        elif op in OPERATORS:
            parts.append(OPERATORS[op](v, arg))
        else:
            raise UnsupportedOperator(f"unsupported filter {op}")
    return reduce(Column.__and__, parts)


def _elements(v: Typed, test, whole: bool = True) -> Column:
    """The test on the value itself, or on any element of an array."""
    if not v.missing and isinstance(v.kind, T.ArrayType):
        inner = v.kind.elementType
        found = F.exists(v.col, lambda x: F.coalesce(test(Typed(x, inner)), F.lit(False)))
        return found | F.coalesce(test(v), F.lit(False)) if whole else found
    return test(v)


def _eq(v: Typed, want: Typed) -> Column:
    return _elements(v, lambda x: equal(x, want))


def _ordering(v: Typed, want: Typed, made) -> Column:
    """Comparisons aren't bracketed by type; a missing value satisfies none, an explicit null is smallest."""
    if v.missing:
        return F.lit(False)
    test = lambda x: made(x, want)
    if isinstance(v.kind, T.ArrayType):
        return _elements(v, test, family(want.kind) == "array")
    return test(v)


def _in(v: Typed, arg: object) -> Column:
    if not isinstance(arg, (list, tuple)):
        raise BadValue("$in needs an array")
    if not arg:
        return F.lit(False)
    kind = v.kind.elementType if not v.missing and isinstance(v.kind, T.ArrayType) else v.kind
    same = [] if v.missing else [x for x in arg if _of_kind(x, kind)]
    rest = [x for x in arg if not any(x is y for y in same)] if len(same) < len(arg) else []
    parts = [_elements(v, lambda x: x.col.isin(*[_bare(y, kind) for y in same]), False)] if same else []
    return _any(parts + [_eq(v, literal(x)) for x in rest])


def _of_kind(x: object, kind: T.DataType) -> bool:
    """Whether a value is one of a column's own type, so that it can be looked up in a list of such."""
    if isinstance(x, bool) or x is None:
        return False
    if isinstance(kind, T.StringType):
        return isinstance(x, str)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return isinstance(x, int) and abs(x) < (2**31 if isinstance(kind, T.IntegerType) else 2**63)
    if isinstance(kind, T.DoubleType):
        return isinstance(x, float) or isinstance(x, int) and abs(x) <= 2**53
    return isinstance(kind, T.TimestampType) and isinstance(x, dt.datetime)


def _bare(x: object, kind: T.DataType) -> object:
    return float(x) if isinstance(kind, T.DoubleType) else literal(x).col if isinstance(x, dt.datetime) else x


def _any(parts: list[Column]) -> Column:
    """One of many, as a balanced tree: a long chain would overflow the planner's stack."""
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _not(v: Typed, arg: object) -> Column:
    if not is_operators(arg):
        raise BadValue("$not needs a document of operators")
    return negate(conditions(v, arg))


def _flag(arg: object) -> bool:
    if not isinstance(arg, (bool, int, float)):
        raise BadValue("$exists needs a boolean or a number")
    return bool(arg)


def _exists(v: Typed, arg: object) -> Column:
    there = F.lit(False) if v.missing else v.col.isNotNull() if v.plain else F.lit(True)
    return there if _flag(arg) else negate(there)


def _type(v: Typed, arg: object) -> Column:
    names = set()
    for x in arg if isinstance(arg, (list, tuple)) else [arg]:
        name = TYPE_IDS.get(int(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
        if name not in TYPE_IDS.values():
            raise BadValue(f"unknown type {x!r}")
        names.add(name)
    if v.missing:
        return F.lit(False)
    if v.null:
        return F.lit("null" in names)
    there = v.col.isNotNull() if alias(v.kind) in names else F.lit(False)
    return there | v.col.isNull() if "null" in names and not v.plain else there


def _all(v: Typed, arg: object) -> Column:
    if not isinstance(arg, (list, tuple)):
        raise BadValue("$all needs an array")
    if not arg or v.missing:
        return F.lit(False)
    return reduce(Column.__and__, [_elem_match(v, x["$elemMatch"]) if isinstance(x, dict) and set(x) == {"$elemMatch"} else _eq(v, literal(x)) for x in arg])


def _elem_match(v: Typed, arg: object) -> Column:
    if not isinstance(arg, dict):
        raise BadValue("$elemMatch needs a document")
    if v.missing or not isinstance(v.kind, T.ArrayType):
        return F.lit(False)
    return F.exists(v.col, lambda x: F.coalesce(element(Typed(x, v.kind.elementType), arg), F.lit(False)))


def element(x: Typed, arg: dict) -> Column:
    """Operators apply to the element itself, any other filter to an element that is a document."""
    if is_operators(arg):
        return conditions(x, arg)
    if not isinstance(x.kind, T.StructType):
        return F.lit(False)
    return x.col.isNotNull() & compile_filter(arg, Env(x.kind, base=x.col))


def _size(v: Typed, arg: object) -> Column:
    if isinstance(arg, bool) or not isinstance(arg, (int, float)) or arg != int(arg) or arg < 0:
        raise BadValue("$size needs a whole number from 0 on")
    if v.missing or not isinstance(v.kind, T.ArrayType):
        return F.lit(False)
    return v.col.isNotNull() & (F.size(v.col) == int(arg))


def _mod(v: Typed, arg: object) -> Column:
    if not isinstance(arg, (list, tuple)) or len(arg) != 2 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in arg):
        raise BadValue("$mod needs a divisor and a remainder")
    by, rest = (int(x) for x in arg)
    if by == 0:
        raise BadValue("$mod by 0")

    def test(x: Typed) -> Column:
        if x.missing or x.null or not is_number(x.kind):
            return F.lit(False)
        whole = x.col
        if isinstance(x.kind, FLOATS):
            fits = ~F.isnan(x.col) & (F.abs(x.col) < 2.0**63)
            whole = F.when(fits, x.col)
        return whole.cast("bigint") % F.lit(by).cast("bigint") == rest

    return _elements(v, test)


def _mask(arg: object) -> tuple[int, bool]:
    """The mask's low 64 bits, and whether it has any above, all of which are copies of the sign."""
    if isinstance(arg, bool):
        raise BadValue("a bit mask is a number, positions or binary data")
    if isinstance(arg, (int, float)):
        if arg != int(arg) or arg < 0:
            raise BadValue("a bit mask is not negative and whole")
        bits = int(arg)
    elif isinstance(arg, (list, tuple)):
        if not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in arg):
            raise BadValue("bit positions are whole numbers from 0 on")
        bits = sum(1 << x for x in set(arg))
    elif isinstance(arg, (bytes, bytearray)):
        bits = int.from_bytes(arg, "little")
    else:
        raise BadValue("a bit mask is a number, positions or binary data")
    return bits & (2**64 - 1), bits >> 64 != 0


def _bits(all_: bool, set_: bool):
    def build(v: Typed, arg: object) -> Column:
        low, high = _mask(arg)
        if high:
            low |= 1 << 63  # a position beyond 63 reads the sign
        signed = low - 2**64 if low >= 2**63 else low

        def test(x: Typed) -> Column:
            if x.missing or x.null or not is_number(x.kind):
                return F.lit(False)
            whole = x.col
            if isinstance(x.kind, FLOATS):
                whole = F.when((x.col == F.rint(x.col)) & (F.abs(x.col) < 2.0**63), x.col)
            both = whole.cast("bigint").bitwiseAND(F.lit(signed).cast("bigint"))
            want = F.lit(signed if set_ else 0).cast("bigint")
            if all_:
                return both == want
            return both != F.lit(0 if set_ else signed).cast("bigint")

        return _elements(v, test)

    return build


def pattern(arg: object, options: str) -> str:
    """A pattern in Java's syntax with the same meaning."""
    if isinstance(arg, Pattern):
        flags = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if arg.flags & f)
        arg, options = arg.pattern, options or flags
    if not isinstance(arg, str) or not isinstance(options, str):
        raise BadValue("$regex needs a pattern")
    if set(options) - set("imsxlu"):
        raise BadValue(f"unknown $options {options!r}")
    if BACKTRACKING.search(arg):
        raise BadValue("look-around, back references and possessive repetition are not supported")
    flags = "".join(sorted(set(options) & set("imsx")))
    # Without m, $ is the very end; Java's would also match before a last line break.
    body = arg if "m" in flags else re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\$", lambda m: r"\z" if m[0] == "$" else m[0], arg)
    return f"(?{flags}Ud){body}"


def _regex(v: Typed, arg: object, options: str) -> Column:
    made = pattern(arg, options)

    def test(x: Typed) -> Column:
        return x.col.rlike(made) if not x.missing and isinstance(x.kind, T.StringType) else F.lit(False)

    return _elements(v, test)


OPERATORS = {
    "$eq": lambda v, x: _eq(v, literal(x)),
    "$ne": lambda v, x: negate(_eq(v, literal(x))),
    "$gt": lambda v, x: _ordering(v, literal(x), lambda a, b: less(b, a)),
    "$gte": lambda v, x: _ordering(v, literal(x), lambda a, b: less(b, a, True)),
    "$lt": lambda v, x: _ordering(v, literal(x), less),
    "$lte": lambda v, x: _ordering(v, literal(x), lambda a, b: less(a, b, True)),
    "$in": _in,
    "$nin": lambda v, x: negate(_in(v, x)),
    "$not": _not,
    "$exists": _exists,
    "$type": _type,
    "$all": _all,
    "$elemMatch": _elem_match,
    "$size": _size,
    "$mod": _mod,
    "$bitsAllSet": _bits(True, True),
    "$bitsAnySet": _bits(False, True),
    "$bitsAllClear": _bits(True, False),
    "$bitsAnyClear": _bits(False, False),
}
