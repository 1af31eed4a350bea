"""Text functions.  Lengths count UTF-8 bytes; positions count characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.registry import FUNCTIONS, need
from tidegraph.types import BOOL, DOUBLE, LONG, STRING, Typed, is_list, is_null, is_object

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _text(name: str, x: Typed) -> Column:
    need(x.type == STRING or is_null(x.type), name, "text")
    return x.col.cast("string")


def _simple(make, *names: str) -> None:
    @FUNCTIONS.register(*names)
    def build(ctx, x: Typed) -> Typed:
        return Typed(make(_text(names[0], x)), STRING)


_simple(F.upper, "toUpper", "upper")
_simple(F.lower, "toLower", "lower")
_simple(lambda c: F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", ""), "trim")
_simple(lambda c: F.regexp_replace(c, f"^{_SPACE}", ""), "ltrim")
_simple(lambda c: F.regexp_replace(c, f"{_SPACE}$", ""), "rtrim")


@FUNCTIONS.register("reverse")
def reverse(ctx, x: Typed) -> Typed:
    need(x.type == STRING or is_list(x.type) or is_null(x.type), "reverse", "text or a list")
    return Typed(F.reverse(x.col), x.type)


def _side(name: str, pick) -> None:
    @FUNCTIONS.register(name)
    def build(ctx, s: Typed, n: Typed) -> Typed:
        need(n.type == LONG or is_null(n.type), name, "an integer count")
        ok = F.when(n.col > 0, n.col.cast("int")).when(n.col.isNotNull(), F.raise_error(F.lit(f"{name}: the count must be positive")).cast("int"))
        return Typed(pick(_text(name, s), ok), STRING)


_side("left", lambda s, n: F.left(s, n))
_side("right", lambda s, n: F.right(s, n))


@FUNCTIONS.register("replace")
def replace(ctx, s: Typed, a: Typed, b: Typed) -> Typed:
    s_, a_, b_ = (_text("replace", x) for x in (s, a, b))
    return Typed(F.when(s_.isNull() | a_.isNull() | b_.isNull(), F.lit(None)).when(a_ == "", s_).otherwise(F.replace(s_, a_, b_)), STRING)


@FUNCTIONS.register("split")
def split(ctx, s: Typed, sep: Typed) -> Typed:
    text, kind = _text("split", s), T.ArrayType(STRING)
    if is_list(sep.type):  # at any of these characters, without empty parts
        classes = F.concat(F.lit("["), F.array_join(F.transform(sep.col, lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), ""), F.lit("]"))
        return Typed(F.filter(F.split(text, classes, -1), lambda p: p != ""), kind)
    quoted = F.concat(F.lit(r"\Q"), F.replace(_text("split", sep), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return Typed(F.split(text, quoted, -1), kind)


@FUNCTIONS.register("substring")
def substring(ctx, s: Typed, start: Typed, length: Typed | None = None) -> Typed:
    text = _text("substring", s)
    n = F.length(text) - start.col if length is None else length.col
    bad = (start.col < 0) | (n < 0) | (start.col + n > F.length(text))
    cut = F.substring(text, (start.col + 1).cast("int"), n.cast("int"))
    return Typed(F.when(bad, F.raise_error(F.lit("substring: out of range")).cast("string")).otherwise(cut), STRING)


def shown(x: Typed) -> Column:
    """Numbers as people write them: whole reals without a fraction, no exponent."""
    if x.type == DOUBLE:
        whole = (x.col == F.floor(x.col)) & (F.abs(x.col) < 1e15)
        return F.when(whole, x.col.cast("long").cast("string")).otherwise(x.col.cast("string"))
    if is_list(x.type):
        inner = F.transform(x.col, lambda e: F.coalesce(shown(Typed(e, x.type.elementType)), F.lit("null")))
        return F.when(x.col.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")))
    return x.col.cast("string")


@FUNCTIONS.register("toString")
def to_string(ctx, x: Typed) -> Typed:
    need(not is_object(x.type), "toString", "a number, text, boolean or list")
    return Typed(shown(x), STRING)


@FUNCTIONS.register("toStringOrNull")
def to_string_or_null(ctx, x: Typed) -> Typed:
    need(x.type != BOOL, "toStringOrNull", "a number, text or list")
    return Typed(F.lit(None).cast("string"), STRING) if is_object(x.type) else to_string(ctx, x)


@FUNCTIONS.register("randomUUID")
def random_uuid(ctx) -> Typed:
    return Typed(F.uuid(), STRING)


@FUNCTIONS.register("char_length", "character_length")
def char_length(ctx, x: Typed) -> Typed:
    return Typed(F.octet_length(_text("char_length", x)).cast("long"), LONG)


@FUNCTIONS.register("size")
def size(ctx, x: Typed) -> Typed:
    if is_list(x.type):
        return Typed(F.when(x.col.isNotNull(), F.size(x.col)).cast("long"), LONG)
    return Typed(F.octet_length(_text("size", x)).cast("long"), LONG)


@FUNCTIONS.register("isEmpty")
def is_empty(ctx, x: Typed) -> Typed:
    if is_list(x.type) or isinstance(x.type, T.MapType):
        return Typed(F.size(x.col) == 0, BOOL)
    if is_object(x.type):
        return Typed(F.lit(not x.type.fields), BOOL)
    return Typed(F.octet_length(_text("isEmpty", x)) == 0, BOOL)
