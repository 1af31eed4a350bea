"""Numeric, trigonometric and conversion functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions.registry import FUNCTIONS, need
from tidegraph.functions.text import to_string
from tidegraph.types import BOOL, DOUBLE, LONG, STRING, LoweringError, Typed, cast_to, common, is_null, is_number


def _number(name: str, x: Typed) -> Column:
    need(is_number(x.type) or is_null(x.type), name, "a number")
    return x.col


def _real(make, *names: str) -> None:
    @FUNCTIONS.register(*names)
    def build(ctx, x: Typed) -> Typed:
        return Typed(make(_number(names[0], x).cast("double")).cast("double"), DOUBLE)


for _make, _name in ((F.ceil, "ceil"), (F.floor, "floor"), (F.cos, "cos"), (F.sin, "sin"), (F.tan, "tan"), (F.degrees, "degrees"), (F.radians, "radians")):
    _real(_make, _name)


@FUNCTIONS.register("abs")
def absolute(ctx, x: Typed) -> Typed:
    return Typed(F.abs(_number("abs", x)), x.type)


@FUNCTIONS.register("sign")
def sign(ctx, x: Typed) -> Typed:
    return Typed(F.signum(_number("sign", x)).cast("long"), LONG)


@FUNCTIONS.register("pi")
def pi(ctx) -> Typed:
    return Typed(F.lit(math.pi), DOUBLE)


@FUNCTIONS.register("rand")
def rand(ctx) -> Typed:
    return Typed(F.rand(), DOUBLE)


#: How each mode rounds a scaled real to a whole one.
_MODES = {
    "UP": lambda v: F.when(v < 0, F.floor(v)).otherwise(F.ceil(v)),
    "DOWN": lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)),
    "CEILING": lambda v: F.ceil(v),
    "FLOOR": lambda v: F.floor(v),
    "HALF_UP": lambda v: F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)),
    "HALF_DOWN": lambda v: F.when(v < 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)),
    "HALF_EVEN": lambda v: F.rint(v),
}


def _nearest(v: Column) -> Column:
    """Half away from zero, but a negative half towards it."""
    return F.floor(v + 0.5)


@FUNCTIONS.register("round")
def rounded(ctx, x: Typed, places: Typed | None = None, mode: Typed | None = None) -> Typed:
    v = _number("round", x).cast("double")
    if places is None:
        return Typed(_nearest(v).cast("double"), DOUBLE)
    if mode is not None and mode.literal not in _MODES:
        raise LoweringError(f"round: the mode must be one of {', '.join(_MODES)}")
    scale = F.pow(F.lit(10.0), places.col)
    whole = _MODES[mode.literal] if mode is not None else _nearest
    found = whole(v * scale).cast("double") / scale
    return Typed(x.col, LONG) if x.type == LONG else Typed(found, DOUBLE)


@FUNCTIONS.register("toInteger")
def to_integer(ctx, x: Typed) -> Typed:
    if x.type == LONG or is_null(x.type):
        return Typed(x.col.cast("long"), LONG)
    if x.type == BOOL:
        return Typed(x.col.cast("long"), LONG)
    need(x.type in (DOUBLE, STRING), "toInteger", "a number, boolean or text")
    exact = x.col.try_cast("long") if x.type == STRING else F.lit(None)
    if x.type == STRING:
        exact = F.when(x.col.rlike(r"^[+-]?\d+$"), exact)
    real = x.col.try_cast("double")
    return Typed(F.coalesce(exact, F.when(F.abs(real) < 9.2e18, F.floor(real).cast("long"))), LONG)


@FUNCTIONS.register("toIntegerOrNull")
def to_integer_or_null(ctx, x: Typed) -> Typed:
    return to_integer(ctx, x) if x.type in (LONG, DOUBLE, STRING, BOOL) else Typed(F.lit(None).cast("long"), LONG)


@FUNCTIONS.register("toFloat")
def to_float(ctx, x: Typed) -> Typed:
    need(is_number(x.type) or x.type == STRING or is_null(x.type), "toFloat", "a number or text")
    return Typed(x.col.try_cast("double"), DOUBLE)


@FUNCTIONS.register("toFloatOrNull")
def to_float_or_null(ctx, x: Typed) -> Typed:
    return to_float(ctx, x) if is_number(x.type) or x.type == STRING else Typed(F.lit(None).cast("double"), DOUBLE)


def _boolean(x: Typed, text: Column) -> Typed:
    if x.type == LONG:
        return Typed(x.col != 0, BOOL)
    if x.type == BOOL:
        return x
    return Typed(F.when(text == "true", True).when(text == "false", False), BOOL)


@FUNCTIONS.register("toBoolean")
def to_boolean(ctx, x: Typed) -> Typed:
    need(x.type in (LONG, STRING, BOOL) or is_null(x.type), "toBoolean", "an integer, text or boolean")
    return _boolean(x, F.lower(x.col.cast("string")))


@FUNCTIONS.register("toBooleanOrNull")
def to_boolean_or_null(ctx, x: Typed) -> Typed:
    return _boolean(x, x.col.cast("string")) if x.type in (LONG, STRING, BOOL) else Typed(F.lit(None).cast("boolean"), BOOL)


@FUNCTIONS.register("CAST")
def cast(ctx, x: Typed, kind: Typed) -> Typed:
    makers = {"STRING": to_string, "INTEGER": to_integer, "INT": to_integer, "FLOAT": to_float, "BOOLEAN": to_boolean, "BOOL": to_boolean}
    need(kind.literal in makers, "CAST", f"one of {', '.join(makers)}")
    return makers[kind.literal](ctx, x)


@FUNCTIONS.register("coalesce")
def coalesce(ctx, *xs: Typed) -> Typed:
    kind = common([x.type for x in xs])
    return Typed(F.coalesce(*[cast_to(x, kind) for x in xs]), kind)


@FUNCTIONS.register("nullIf")
def null_if(ctx, a: Typed, b: Typed) -> Typed:
    kind = common([a.type, b.type])
    if not (is_number(kind) or a.type == b.type):
        return a
    return Typed(F.when(~cast_to(a, kind).eqNullSafe(cast_to(b, kind)), a.col), a.type)


@FUNCTIONS.register("timestamp")
def timestamp(ctx) -> Typed:
    return Typed(F.unix_millis(ctx.wall), LONG)


