"""List functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.registry import FUNCTIONS, need
from tidegraph.types import DOUBLE, LONG, Typed, cast_to, common, is_list, is_null, is_number


def _list(name: str, x: Typed) -> Typed:
    need(is_list(x.type) or is_null(x.type), name, "a list")
    return x if is_list(x.type) else Typed(x.col.cast(T.ArrayType(T.NullType())), T.ArrayType(T.NullType()))


@FUNCTIONS.register("head")
def head(ctx, x: Typed) -> Typed:
    x = _list("head", x)
    return Typed(F.try_element_at(x.col, F.lit(1)), x.type.elementType)


@FUNCTIONS.register("last")
def last(ctx, x: Typed) -> Typed:
    x = _list("last", x)
    return Typed(F.try_element_at(x.col, F.lit(-1)), x.type.elementType)


@FUNCTIONS.register("tail")
def tail(ctx, x: Typed) -> Typed:
    x = _list("tail", x)
    return Typed(F.when(F.size(x.col) > 0, F.slice(x.col, F.lit(2), F.size(x.col))), x.type)


@FUNCTIONS.register("range")
def numbers(ctx, a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    need(all(x.type == LONG for x in (a, b) + ((step,) if step else ())), "range", "integers")
    by = step.col if step else F.lit(1).cast("long")
    runs = ((by > 0) & (a.col <= b.col)) | ((by < 0) & (a.col >= b.col))
    return Typed(F.when(runs, F.sequence(a.col, b.col, F.when(runs, by).otherwise(F.signum(b.col - a.col).cast("long")))).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


@FUNCTIONS.register("coll.distinct")
def distinct(ctx, x: Typed) -> Typed:
    return Typed(F.array_distinct(_list("coll.distinct", x).col), x.type)


@FUNCTIONS.register("coll.indexOf")
def index_of(ctx, x: Typed, item: Typed) -> Typed:
    kind = common([x.type.elementType, item.type])
    wanted = cast_to(item, kind)
    same = F.transform(cast_to(x, T.ArrayType(kind)), lambda e: e.eqNullSafe(wanted))
    return Typed(F.when(x.col.isNotNull(), (F.array_position(same, True) - 1).cast("long")), LONG)


@FUNCTIONS.register("coll.insert")
def insert(ctx, x: Typed, at: Typed, item: Typed) -> Typed:
    kind = T.ArrayType(common([x.type.elementType, item.type]))
    bad = (at.col < 0) | (at.col > F.size(x.col))
    put = F.array_insert(cast_to(x, kind), (at.col + 1).cast("int"), cast_to(item, kind.elementType))
    return Typed(F.when(bad, F.raise_error(F.lit("coll.insert: index out of range")).cast(kind)).otherwise(put), kind)


def _extreme(name: str, pick) -> None:
    @FUNCTIONS.register(name)
    def build(ctx, x: Typed) -> Typed:
        return Typed(pick(x.col), x.type.elementType) if is_list(x.type) else x


_extreme("listMax", F.array_max)
_extreme("listMin", F.array_min)


@FUNCTIONS.register("stdevp")
def stdevp(ctx, x: Typed) -> Typed:
    """Population standard deviation of a list's numbers."""
    need(is_list(x.type) and (is_number(x.type.elementType) or is_null(x.type.elementType)), "stdevp", "a list of numbers")
    held = F.filter(x.col.cast("array<double>"), lambda e: e.isNotNull())
    zero = F.lit(0.0)
    mean = F.aggregate(held, zero, lambda a, e: a + e) / F.size(held)
    var = F.aggregate(F.transform(held, lambda e: (e - mean) * (e - mean)), zero, lambda a, e: a + e) / F.size(held)
    return Typed(F.when(F.size(held) > 0, F.sqrt(var)), DOUBLE)
