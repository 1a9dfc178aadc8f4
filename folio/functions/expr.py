"""Expressions compiled to typed columns.

Types are known when a query is compiled, so wrong types raise then; what depends on values (division by zero, the root
of a negative number, a document that is null) raises in the query by raise_error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue, UnsupportedOperator
from ..order import compare, equal, less
from ..paths import Env, step
from ..types import DATES, FLOATS, INTS, MISSING, Typed, alias, cast, family, is_number, literal, null, unify

LONG, DOUBLE, STRING, BOOL, DATE = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()
OPERATORS: dict[str, Callable] = {}


def operator(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        OPERATORS.update(dict.fromkeys(names, f))
        return f

    return add


def compile_expr(e: object, env: Env) -> Typed:
    """The value of an expression for each document."""
    if isinstance(e, str):
        if e.startswith("$$"):
            name, _, path = e[2:].partition(".")
            if name == "NOW":
                base = literal(env.now)
            elif name in ("ROOT", "CURRENT"):
                return env.field(path) if path else env.root()
            elif name in env.variables:
                base = env.variables[name]
            else:
                raise BadValue(f"unknown variable $${name}")
            return step(base, path.split(".")) if path else base
        return env.field(e[1:]) if e.startswith("$") and len(e) > 1 else literal(e)
    if isinstance(e, (list, tuple)):
        items = [compile_expr(x, env).as_null() for x in e]
        if not items:
            return literal([])
        kind = unify([x.kind for x in items])
        return Typed(F.array(*[cast(x, kind) for x in items]), T.ArrayType(kind))
    if isinstance(e, dict):
        if any(k.startswith("$") for k in e):
            if len(e) != 1:
                raise BadValue("an operator expression has one operator")
            name, arg = next(iter(e.items()))
            if name not in OPERATORS:
                raise UnsupportedOperator(f"unsupported expression {name}")
            return OPERATORS[name](arg, env)
        fields = {k: v for k, x in e.items() if not (v := compile_expr(x, env)).missing}
        made = F.struct(*[v.col.alias(k) for k, v in fields.items()]) if fields else F.struct()
        return Typed(made, T.StructType([T.StructField(k, v.kind) for k, v in fields.items()]))
    return literal(e)


def truthy(v: Typed) -> Column:
    """Whether a value counts as true: all but null, false and zero. Never null."""
    if v.missing or v.null:
        return F.lit(False)
    if isinstance(v.kind, T.BooleanType):
        return v.col if v.constant is not None else F.coalesce(v.col, F.lit(False))
    if family(v.kind) == "number":
        return F.coalesce(v.col != 0, F.lit(False))
    return v.col.isNotNull()


def condition(e: object, env: Env) -> Column:
    """Truth of an expression as a filter's predicate: null may stand for false, so comparisons stay bare for the scan."""
    if isinstance(e, dict) and len(e) == 1:
        name, arg = next(iter(e.items()))
        if name in COMPARISONS:
            return COMPARISONS[name](*_args(arg, env, 2, 2, name))
        if name == "$and" and isinstance(arg, (list, tuple)) and arg:
            return reduce(Column.__and__, [condition(x, env) for x in arg])
    return truthy(compile_expr(e, env))


def _args(arg: object, env: Env, low: int, high: int | None, name: str) -> list[Typed]:
    given = list(arg) if isinstance(arg, (list, tuple)) else [arg]
    if len(given) < low or high is not None and len(given) > high:
        raise BadValue(f"{name} takes {low if low == high else f'{low} to {high or 'any number of'}'} arguments")
    return [compile_expr(x, env) for x in given]


def _fail(why: str) -> Column:
    return F.raise_error(F.lit(why))


def _guard(bad: Column, why: str, value: Column) -> Column:
    return F.when(bad, _fail(why)).otherwise(value)


def _number(v: Typed, name: str) -> Typed:
    v = v.as_null()
    if not v.null and not is_number(v.kind):
        raise BadValue(f"{name} needs numbers, not {alias(v.kind)}")
    return v


def _string(v: Typed, name: str) -> Typed:
    v = v.as_null()
    if not v.null and not isinstance(v.kind, T.StringType):
        raise BadValue(f"{name} needs strings, not {alias(v.kind)}")
    return v


def _array(v: Typed, name: str, nullable: bool = True) -> Typed:
    v = v.as_null()
    if v.null and not nullable or not v.null and not isinstance(v.kind, T.ArrayType):
        raise BadValue(f"{name} needs an array, not {'null' if v.null else alias(v.kind)}")
    return v


def _wide(v: Typed) -> Column:
    return v.col.cast(LONG) if isinstance(v.kind, INTS) and not isinstance(v.kind, T.LongType) else v.col


def _result(values: list[Typed]) -> T.DataType:
    return DOUBLE if any(isinstance(v.kind, FLOATS) for v in values) else LONG


def _millis(v: Typed) -> Column:
    return F.unix_millis(v.col.cast(DATE))


def _is_date(v: Typed) -> bool:
    return isinstance(v.kind, DATES)


@operator("$literal")
def _literal(arg: object, env: Env) -> Typed:
    return literal(arg)


# -- comparison and logic


COMPARISONS: dict[str, Callable[[Typed, Typed], Column]] = {
    "$eq": equal, "$ne": lambda a, b: ~F.coalesce(equal(a, b), F.lit(False)), "$lt": less, "$lte": lambda a, b: less(a, b, True), "$gt": lambda a, b: less(b, a), "$gte": lambda a, b: less(b, a, True),
}


def _comparison(name: str) -> None:
    OPERATORS[name] = lambda arg, env: Typed(F.coalesce(COMPARISONS[name](*_args(arg, env, 2, 2, name)), F.lit(False)), BOOL)


for _name in COMPARISONS:
    _comparison(_name)


@operator("$cmp")
def _cmp(arg: object, env: Env) -> Typed:
    return Typed(compare(*_args(arg, env, 2, 2, "$cmp")).cast(LONG), LONG)


@operator("$and")
def _and(arg: object, env: Env) -> Typed:
    return Typed(reduce(Column.__and__, [truthy(v) for v in _args(arg, env, 0, None, "$and")], F.lit(True)), BOOL)


@operator("$or")
def _or(arg: object, env: Env) -> Typed:
    return Typed(reduce(Column.__or__, [truthy(v) for v in _args(arg, env, 0, None, "$or")], F.lit(False)), BOOL)


@operator("$not")
def _not(arg: object, env: Env) -> Typed:
    return Typed(~truthy(_args(arg, env, 1, 1, "$not")[0]), BOOL)


# -- conditions


def _choose(cases: list[tuple[Column, Typed]], other: Typed | None, why: str = "") -> Typed:
    values = [v.as_null() for _, v in cases] + ([other.as_null()] if other else [])
    kind = unify([v.kind for v in values])
    col = None
    for (test, _), v in zip(cases, values):
        col = F.when(test, cast(v, kind)) if col is None else col.when(test, cast(v, kind))
    last = cast(values[-1], kind) if other else _fail(why).cast(kind)
    return Typed(last if col is None else col.otherwise(last), kind)


@operator("$cond")
def _cond(arg: object, env: Env) -> Typed:
    if isinstance(arg, dict):
        if set(arg) != {"if", "then", "else"}:
            raise BadValue("$cond needs if, then and else")
        arg = [arg["if"], arg["then"], arg["else"]]
    test, yes, no = _args(arg, env, 3, 3, "$cond")
    return _choose([(truthy(test), yes)], no)


@operator("$ifNull")
def _if_null(arg: object, env: Env) -> Typed:
    values = [v for v in _args(arg, env, 2, None, "$ifNull")]
    last, known = values[-1], [v for v in values if not v.missing and not v.null]
    if not known:
        return last
    kind = unify([v.kind for v in known])
    return Typed(F.coalesce(*[cast(v, kind) for v in known]), kind)


@operator("$switch")
def _switch(arg: object, env: Env) -> Typed:
    if not isinstance(arg, dict) or not isinstance(arg.get("branches"), (list, tuple)) or set(arg) - {"branches", "default"}:
        raise BadValue("$switch needs branches")
    cases = []
    for b in arg["branches"]:
        if not isinstance(b, dict) or set(b) != {"case", "then"}:
            raise BadValue("a branch of $switch has case and then")
        cases.append((truthy(compile_expr(b["case"], env)), compile_expr(b["then"], env)))
    if not cases:
        raise BadValue("$switch needs a branch")
    return _choose(cases, compile_expr(arg["default"], env) if "default" in arg else None, "$switch: no branch matched and there is no default")


# -- arithmetic


@operator("$add")
def _add(arg: object, env: Env) -> Typed:
    values = [v.as_null() for v in _args(arg, env, 1, None, "$add")]
    dates = [v for v in values if _is_date(v)]
    if len(dates) > 1:
        raise BadValue("$add takes one date at most")
    rest = [_number(v, "$add") for v in values if not _is_date(v)]
    if any(v.null for v in values):
        return null()
    if dates:
        total = reduce(Column.__add__, [_wide(v) for v in rest], _millis(dates[0]))
        return Typed(F.timestamp_millis(F.round(total).cast(LONG) if _result(rest) == DOUBLE else total), DATE)
    kind = _result(rest)
    return Typed(reduce(Column.__add__, [_wide(v).cast(kind) for v in rest]), kind)


@operator("$subtract")
def _subtract(arg: object, env: Env) -> Typed:
    a, b = (v.as_null() for v in _args(arg, env, 2, 2, "$subtract"))
    if a.null or b.null:
        return null()
    if _is_date(a) and _is_date(b):
        return Typed(_millis(a) - _millis(b), LONG)
    if _is_date(a):
        return Typed(F.timestamp_millis(_millis(a) - _number(b, "$subtract").col.cast(LONG)), DATE)
    kind = _result([_number(a, "$subtract"), _number(b, "$subtract")])
    return Typed(_wide(a).cast(kind) - _wide(b).cast(kind), kind)


@operator("$multiply")
def _multiply(arg: object, env: Env) -> Typed:
    values = [_number(v, "$multiply") for v in _args(arg, env, 1, None, "$multiply")]
    if any(v.null for v in values):
        return null()
    kind = _result(values)
    return Typed(reduce(Column.__mul__, [_wide(v).cast(kind) for v in values]), kind)


@operator("$divide")
def _divide(arg: object, env: Env) -> Typed:
    a, b = (_number(v, "$divide") for v in _args(arg, env, 2, 2, "$divide"))
    if a.null or b.null:
        return null()
    return Typed(_guard(b.col == 0, "$divide by zero", a.col.cast(DOUBLE) / F.nullif(b.col.cast(DOUBLE), F.lit(0.0))), DOUBLE)


@operator("$mod")
def _mod(arg: object, env: Env) -> Typed:
    a, b = (_number(v, "$mod") for v in _args(arg, env, 2, 2, "$mod"))
    if a.null or b.null:
        return null()
    kind = _result([a, b])
    return Typed(_guard(b.col == 0, "$mod by zero", a.col.cast(kind) % F.nullif(b.col.cast(kind), F.lit(0).cast(kind))), kind)


@operator("$pow")
def _pow(arg: object, env: Env) -> Typed:
    a, b = (_number(v, "$pow") for v in _args(arg, env, 2, 2, "$pow"))
    if a.null or b.null:
        return null()
    if _result([a, b]) == LONG and isinstance(b.constant, int) and b.constant >= 0:
        return Typed(_whole_power(_wide(a), b.constant), LONG)
    return Typed(F.pow(a.col.cast(DOUBLE), b.col.cast(DOUBLE)), DOUBLE)


def _whole_power(base: Column, n: int) -> Column:
    """Exact, by squaring; overflow raises. Beyond 63 only -1, 0 and 1 have powers of 64 bits."""
    if n > 63:
        small = F.when(base.isin(0, 1), base).when(base == -1, F.lit(1 - n % 2 * 2).cast(LONG))
        return F.when(F.abs(base) > 1, _fail("$pow of more than 64 bits").cast(LONG)).otherwise(small)
    made, square = None, base
    while n:
        if n & 1:
            made = square if made is None else made * square
        n >>= 1
        square = square * square if n else square
    return F.when(base.isNotNull(), F.lit(1).cast(LONG)) if made is None else made


def _unary(name: str, on_float: Callable[[Column], Column], on_int: Callable[[Column], Column] = lambda c: c) -> None:
    def build(arg: object, env: Env) -> Typed:
        v = _number(_args(arg, env, 1, 1, name)[0], name)
        if v.null:
            return null()
        return Typed(on_float(v.col).cast(DOUBLE), DOUBLE) if isinstance(v.kind, FLOATS) else Typed(on_int(_wide(v)), LONG)

    OPERATORS[name] = build


def _float_only(name: str, made: Callable[[Column], Column], bad: Callable[[Column], Column] | None = None) -> None:
    def build(arg: object, env: Env) -> Typed:
        v = _number(_args(arg, env, 1, 1, name)[0], name)
        if v.null:
            return null()
        x = v.col.cast(DOUBLE)
        return Typed(_guard(bad(x), f"{name} of a number out of range", made(x)) if bad else made(x), DOUBLE)

    OPERATORS[name] = build


def _whole(rounded: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding that leaves alone what has no fraction, be it beyond 64 bits or no number."""
    return lambda c: F.when((F.abs(c) >= 2.0**53) | F.isnan(c), c).otherwise(rounded(F.when(F.abs(c) < 2.0**53, c)).cast(DOUBLE))


_unary("$abs", F.abs, F.abs)
_unary("$ceil", _whole(F.ceil))
_unary("$floor", _whole(F.floor))
_unary("$trunc", _whole(lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))))
_float_only("$sqrt", F.sqrt, lambda c: c < 0)
_float_only("$exp", F.exp)
_float_only("$ln", F.ln, lambda c: c <= 0)
_float_only("$log10", F.log10, lambda c: c <= 0)


@operator("$round")
def _round(arg: object, env: Env) -> Typed:
    values = [_number(v, "$round") for v in _args(arg, env, 1, 2, "$round")]
    v, places = values[0], values[1] if len(values) > 1 else literal(0)
    if v.null or places.null:
        return null()
    if isinstance(v.kind, INTS) and isinstance(places.constant, int) and places.constant >= 0:
        return Typed(_wide(v), LONG)
    scale = F.pow(F.lit(10.0), places.col.cast(DOUBLE))
    at, half = v.col.cast(DOUBLE) * scale, _whole(lambda c: F.rint(c))
    made = half(at) / scale
    return Typed(made.cast(LONG), LONG) if isinstance(v.kind, INTS) else Typed(made, DOUBLE)


@operator("$rand")
def _rand(arg: object, env: Env) -> Typed:
    if arg not in ({}, []):
        raise BadValue("$rand takes no arguments")
    return Typed(F.rand(), DOUBLE)


# -- strings


@operator("$concat")
def _concat(arg: object, env: Env) -> Typed:
    values = [_string(v, "$concat") for v in _args(arg, env, 0, None, "$concat")]
    return null() if any(v.null for v in values) else Typed(F.concat(*[v.col for v in values]) if values else F.lit(""), STRING)


def _of_string(name: str, made: Callable[[Column], Column], kind: T.DataType = STRING) -> None:
    def build(arg: object, env: Env) -> Typed:
        v = _string(_args(arg, env, 1, 1, name)[0], name)
        return null() if v.null else Typed(made(v.col), kind)

    OPERATORS[name] = build


_of_string("$toUpper", F.upper)
_of_string("$toLower", F.lower)
_of_string("$strLenCP", lambda c: F.length(c).cast(LONG), LONG)


@operator("$substrCP")
def _substr(arg: object, env: Env) -> Typed:
    text, start, size = _args(arg, env, 3, 3, "$substrCP")
    text = _string(text, "$substrCP")
    start, size = _number(start, "$substrCP"), _number(size, "$substrCP")
    if text.null:
        return literal("")
    s, n = start.col.cast("int"), size.col.cast("int")
    made = F.coalesce(F.substring(text.col, s + 1, n), F.lit(""))
    if all(isinstance(v.constant, int) for v in (start, size)):
        if start.constant < 0 or size.constant < 0:
            raise BadValue("$substrCP takes no negative numbers")
        return Typed(made, STRING)
    return Typed(_guard((s < 0) | (n < 0), "$substrCP takes no negative numbers", made), STRING)


@operator("$split")
def _split(arg: object, env: Env) -> Typed:
    text, by = (_string(v, "$split") for v in _args(arg, env, 2, 2, "$split"))
    if text.null or by.null:
        return null()
    if by.constant == "":
        raise BadValue("$split needs a delimiter")
    quoted = F.concat(F.lit("\\Q"), F.replace(by.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    made = F.split(text.col, quoted, -1)
    return Typed(made if by.constant else _guard(by.col == "", "$split needs a delimiter", made), T.ArrayType(STRING))


def _trim(name: str, left: bool, right: bool) -> None:
    def build(arg: object, env: Env) -> Typed:
        if not isinstance(arg, dict) or "input" not in arg or set(arg) - {"input", "chars"}:
            raise BadValue(f"{name} needs input")
        text = _string(compile_expr(arg["input"], env), name)
        if text.null:
            return null()
        if "chars" not in arg:
            ends = [r"(?U)^\s+"] * left + [r"(?U)\s+\z"] * right
            return Typed(reduce(lambda c, p: F.regexp_replace(c, p, ""), ends, text.col), STRING)
        chars = _string(compile_expr(arg["chars"], env), name)
        if chars.null:
            return null()
        made = F.btrim if left and right else F.ltrim if left else F.rtrim
        return Typed(made(text.col, chars.col), STRING)

    OPERATORS[name] = build


_trim("$trim", True, True)
_trim("$ltrim", True, False)
_trim("$rtrim", False, True)


# -- arrays


@operator("$size")
def _size(arg: object, env: Env) -> Typed:
    v = _array(_args(arg, env, 1, 1, "$size")[0], "$size", False)
    return Typed(_guard(v.col.isNull(), "$size of null", F.size(v.col).cast(LONG)), LONG)


@operator("$isArray")
def _is_array(arg: object, env: Env) -> Typed:
    v = _args(arg, env, 1, 1, "$isArray")[0]
    return Typed(v.col.isNotNull() if isinstance(v.kind, T.ArrayType) else F.lit(False), BOOL)


@operator("$in")
def _in(arg: object, env: Env) -> Typed:
    needle, hay = _args(arg, env, 2, 2, "$in")
    hay = _array(hay, "$in", False)
    inner = hay.kind.elementType
    found = F.exists(hay.col, lambda x: F.coalesce(equal(Typed(x, inner), needle), F.lit(False)))
    return Typed(found if hay.constant is not None else _guard(hay.col.isNull(), "$in needs an array", found), BOOL)


@operator("$arrayElemAt")
def _element(arg: object, env: Env) -> Typed:
    v, at = _args(arg, env, 2, 2, "$arrayElemAt")
    v, at = _array(v, "$arrayElemAt"), _number(at, "$arrayElemAt")
    if v.null or at.null:
        return null()
    i = at.col.cast("int")
    return Typed(F.get(v.col, F.when(i < 0, F.size(v.col) + i).otherwise(i)), v.kind.elementType)


def _end(name: str, at: int) -> None:
    def build(arg: object, env: Env) -> Typed:
        v = _array(_args(arg, env, 1, 1, name)[0], name)
        return null() if v.null else Typed(F.try_element_at(v.col, F.lit(at)), v.kind.elementType)

    OPERATORS[name] = build


_end("$first", 1)
_end("$last", -1)


@operator("$concatArrays")
def _concat_arrays(arg: object, env: Env) -> Typed:
    values = [_array(v, "$concatArrays") for v in _args(arg, env, 0, None, "$concatArrays")]
    if any(v.null for v in values):
        return null()
    if not values:
        return literal([])
    kind = unify([v.kind for v in values])
    return Typed(F.concat(*[cast(v, kind) for v in values]), kind)


def slice_of(array: Column, size: Column, position: Column | None = None) -> Column:
    """The first elements (the last, for a negative size), or those from a position on, which may count from the end."""
    n = F.size(array)
    if position is None:
        start = F.when(size < 0, F.greatest(n + size, F.lit(0))).otherwise(F.lit(0))
        size = F.abs(size)
    else:
        start = F.when(position < 0, F.greatest(n + position, F.lit(0))).otherwise(position)
    return F.slice(array, start + 1, size)


@operator("$slice")
def _slice(arg: object, env: Env) -> Typed:
    given = _args(arg, env, 2, 3, "$slice")
    v, numbers = _array(given[0], "$slice"), [_number(x, "$slice") for x in given[1:]]
    if v.null or any(x.null for x in numbers):
        return null()
    cols = [x.col.cast("int") for x in numbers]
    if len(cols) == 1:
        return Typed(slice_of(v.col, cols[0]), v.kind)
    if isinstance(numbers[1].constant, int) and numbers[1].constant < 0:
        raise BadValue("$slice takes no negative number of elements after a position")
    return Typed(_guard(cols[1] < 0, "$slice takes no negative number of elements after a position", slice_of(v.col, F.greatest(cols[1], F.lit(0)), cols[0])), v.kind)


def _walk(arg: object, env: Env, name: str, body: str) -> tuple[Typed, str, object]:
    if not isinstance(arg, dict) or not {"input", body} <= set(arg) or set(arg) - {"input", "as", body}:
        raise BadValue(f"{name} needs input and {body}")
    return _array(compile_expr(arg["input"], env), name), arg.get("as", "this"), arg[body]


@operator("$filter")
def _filter(arg: object, env: Env) -> Typed:
    v, name, body = _walk(arg, env, "$filter", "cond")
    if v.null:
        return null()
    return Typed(F.filter(v.col, lambda x: truthy(compile_expr(body, env.bind(name, Typed(x, v.kind.elementType))))), v.kind)


@operator("$map")
def _map(arg: object, env: Env) -> Typed:
    v, name, body = _walk(arg, env, "$map", "in")
    if v.null:
        return null()
    made = lambda x: compile_expr(body, env.bind(name, Typed(x, v.kind.elementType))).as_null()
    probe = made(F.lit(None).cast(v.kind.elementType))
    return Typed(F.transform(v.col, lambda x: made(x).col), T.ArrayType(probe.kind))


@operator("$range")
def _range(arg: object, env: Env) -> Typed:
    given = [_number(v, "$range") for v in _args(arg, env, 2, 3, "$range")]
    start, end, by = given[0], given[1], given[2] if len(given) > 2 else literal(1)
    if by.constant == 0:
        raise BadValue("$range needs a step other than 0")
    a, b, s = (v.col.cast(LONG) for v in (start, end, by))
    last = b - F.signum(s).cast(LONG)
    some = F.when(s > 0, a < b).otherwise(a > b)
    made = F.when(some, F.sequence(a, last, s)).otherwise(F.array().cast("array<bigint>"))
    return Typed(made if by.constant else _guard(s == 0, "$range needs a step other than 0", made), T.ArrayType(LONG))


# -- types


@operator("$type")
def _type(arg: object, env: Env) -> Typed:
    v = _args(arg, env, 1, 1, "$type")[0]
    if v.missing:
        return literal("missing")
    return literal("null") if v.null else Typed(F.when(v.col.isNull(), "null").otherwise(alias(v.kind)), STRING)


def _to_number(name: str, kind: T.DataType, low: float, high: float) -> None:
    def build(arg: object, env: Env) -> Typed:
        v = _args(arg, env, 1, 1, name)[0].as_null()
        if v.null:
            return null()
        if not is_number(v.kind) and not isinstance(v.kind, (T.BooleanType, T.StringType)):
            raise BadValue(f"{name} of {alias(v.kind)}")
        x = F.trim(v.col) if isinstance(v.kind, T.StringType) else v.col
        if kind == DOUBLE:
            return Typed(x.cast(DOUBLE), DOUBLE)
        if isinstance(v.kind, (*INTS, T.BooleanType)) and name == "$toLong":
            return Typed(x.cast(LONG), LONG)
        d = x.cast(DOUBLE)
        whole = F.when(F.isnan(d), F.lit(0.0)).otherwise(d)
        if name == "$toInt":
            return Typed(_guard((whole <= low - 1) | (whole >= high + 1), "$toInt of a number out of range", whole).cast(kind), kind)
        return Typed(F.when(whole >= high, F.lit(2**63 - 1)).when(whole <= low, F.lit(-(2**63))).otherwise(F.when((whole < high) & (whole > low), whole).cast(LONG)), LONG)

    OPERATORS[name] = build


_to_number("$toInt", T.IntegerType(), -(2**31), 2**31 - 1)
_to_number("$toLong", LONG, -(2.0**63), 2.0**63)
_to_number("$toDouble", DOUBLE, 0, 0)


@operator("$toBool")
def _to_bool(arg: object, env: Env) -> Typed:
    v = _args(arg, env, 1, 1, "$toBool")[0].as_null()
    if v.null:
        return null()
    if isinstance(v.kind, T.BooleanType):
        return v
    return Typed(v.col != 0 if is_number(v.kind) else F.when(v.col.isNotNull(), F.lit(True)), BOOL)


@operator("$toDate")
def _to_date(arg: object, env: Env) -> Typed:
    v = _args(arg, env, 1, 1, "$toDate")[0].as_null()
    if v.null or _is_date(v):
        return v
    return Typed(F.timestamp_millis(_number(v, "$toDate").col.cast(LONG)), DATE)


@operator("$toString")
def _to_string(arg: object, env: Env) -> Typed:
    v = _args(arg, env, 1, 1, "$toString")[0].as_null()
    if v.null:
        return null()
    if family(v.kind) in ("array", "object"):
        raise BadValue(f"$toString of {alias(v.kind)}")
    if _is_date(v):
        return Typed(_date_text(v), STRING)
    if isinstance(v.kind, FLOATS):
        return Typed(_plain_double(v.col.cast(DOUBLE)), STRING)
    return Typed(v.col.cast(STRING), STRING)


def _plain_double(x: Column) -> Column:
    """A double's shortest digits without an exponent, and without a fraction where it has none."""
    text = x.cast(STRING)
    whole = F.when((x == F.rint(x)) & (F.abs(x) < 1e15), x.cast(LONG).cast(STRING))
    exact = F.regexp_replace(F.when(text.contains("E") & (F.abs(x) < 1e20), x.cast("decimal(38,18)").cast(STRING)).otherwise(text), r"(\.\d*?)0+\z", "$1")
    special = F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
    return F.coalesce(special, whole, F.regexp_replace(exact, r"\.\z", ""))


# -- dates


def _date_text(v: Typed) -> Column:
    """A date in UTC as text, years outside 0 to 9,999 in their plain digits. date_format would read the session's zone."""
    millis, text = F.pmod(_millis(v), F.lit(1000)), F.replace(F.substring_index(_utc(v).cast(STRING), ".", 1), F.lit(" "), F.lit("T"))
    signed = text.startswith("+") | text.startswith("-")
    digits = F.when(signed, F.regexp_replace(text, r"^\+|(?<=^-)0+(?=\d)", "")).otherwise(text)
    return F.concat(digits, F.when(millis == 0, F.lit("Z")).otherwise(F.concat(F.lit("."), F.lpad(millis.cast(STRING), 3, "0"), F.lit("Z"))))


def _part(name: str, made: Callable[[Column], Column]) -> None:
    def build(arg: object, env: Env) -> Typed:
        v = _args(arg, env, 1, 1, name)[0].as_null()
        if v.null:
            return null()
        if not _is_date(v):
            raise BadValue(f"{name} needs a date, not {alias(v.kind)}")
        return Typed(made(_utc(v)).cast(LONG), LONG)

    OPERATORS[name] = build


def _utc(v: Typed) -> Column:
    """A date as Spark's functions read it, in UTC whatever zone the session is in. Elsewhere it has a type without zone."""
    if not isinstance(v.kind, T.TimestampType):
        return v.col.cast("timestamp_ntz")
    session = SparkSession.getActiveSession()
    if session is None or session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return v.col
    return F.timestamp_add("MICROSECOND", F.unix_micros(v.col), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


for _name, _made in {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second,
    "$millisecond": lambda c: F.pmod(F.unix_millis(c.cast(DATE)), F.lit(1000)), "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear,
}.items():
    _part(_name, _made)
