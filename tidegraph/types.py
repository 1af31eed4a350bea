"""Values of the query languages as Spark columns with their types."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOL, DATE, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.NullType()
LOCAL_DATETIME, DATETIME = T.TimestampNTZType(), T.TimestampType()
#: Calendar and clock parts are kept apart: adding a duration to an instant uses ``nanos`` only.
DURATION = T.StructType([T.StructField("years", LONG), T.StructField("months", LONG), T.StructField("nanos", LONG)])
LOCAL_TIME = T.StructType([T.StructField("nanos_of_day", LONG)])
ZONED_TIME = T.StructType([T.StructField("nanos_of_day", LONG), T.StructField("offset_s", LONG)])

INSTANTS = (DATE, LOCAL_DATETIME, DATETIME, LOCAL_TIME, ZONED_TIME)
DAY_NS, SECOND_NS = 86_400_000_000_000, 1_000_000_000


class LoweringError(ValueError):
    """A query that cannot be turned into a plan, found before anything runs."""


@dataclass(frozen=True)
class Typed:
    """A column and its type; ``fields`` for object literals, ``node`` for elements, ``literal`` for constants."""

    col: Column
    type: T.DataType
    fields: dict[str, Typed] = field(default_factory=dict)
    node: str | None = None
    literal: object = None


def lit(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None), NULL)
    kind = BOOL if isinstance(value, bool) else LONG if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING
    return Typed(F.lit(value).cast(kind), kind, literal=value)


def widened(t: T.DataType) -> T.DataType:
    """Integers as 64 bits, reals as doubles, small text as string."""
    if isinstance(t, T.IntegralType):
        return LONG
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return DOUBLE
    if isinstance(t, (T.CharType, T.VarcharType)):
        return STRING
    if isinstance(t, T.ArrayType):
        return T.ArrayType(widened(t.elementType))
    return t


def of_column(col: Column, t: T.DataType) -> Typed:
    wide = widened(t)
    return Typed(col if wide == t else col.cast(wide), wide)


def is_number(t: T.DataType) -> bool:
    return t in (LONG, DOUBLE)


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_object(t: T.DataType) -> bool:
    return isinstance(t, (T.StructType, T.MapType)) and t not in (DURATION, LOCAL_TIME, ZONED_TIME)


def as_bool(x: Typed) -> Column:
    """A predicate: what is not a true boolean is false."""
    return F.coalesce(x.col, F.lit(False)) if x.type == BOOL else F.lit(False)


def common(types: list[T.DataType]) -> T.DataType:
    """The type lists and branches of these types share."""
    known = [t for t in types if not is_null(t)]
    if not known:
        return NULL
    if all(t == known[0] for t in known):
        return known[0]
    if all(map(is_number, known)):
        return DOUBLE
    if all(map(is_list, known)):
        return T.ArrayType(common([t.elementType for t in known]))
    return T.VariantType()


def cast_to(x: Typed, t: T.DataType) -> Column:
    if x.type == t or is_null(t):
        return x.col
    if isinstance(t, T.VariantType):
        return F.to_variant_object(x.col) if isinstance(x.type, (T.StructType, T.ArrayType, T.MapType)) else x.col.cast(t)
    return x.col.cast(t)


def epoch_nanos(x: Typed) -> Column:
    """Nanoseconds on one line for instants: dates at midnight, times on day 0, zones as UTC."""
    if x.type == DATE:
        return F.unix_date(x.col).cast("long") * DAY_NS
    if x.type == LOCAL_DATETIME:
        day = x.col.cast("date")
        clock = (F.hour(x.col) * 3600 + F.minute(x.col) * 60).cast("long") * SECOND_NS
        seconds = F.extract(F.lit("SECOND"), x.col)
        return F.unix_date(day).cast("long") * DAY_NS + clock + (seconds * SECOND_NS).cast("long")
    if x.type == DATETIME:
        return F.unix_micros(x.col) * 1000
    if x.type == LOCAL_TIME:
        return x.col["nanos_of_day"]
    if x.type == ZONED_TIME:
        return x.col["nanos_of_day"] - x.col["offset_s"] * SECOND_NS
    raise LoweringError(f"{x.type.simpleString()} is no instant")


def floor_div(a: Column, b: int) -> Column:
    """Whole part of a long over a positive integer, exactly: doubles would lose digits of nanoseconds.

    The quotient of decimals has more digits than the divisor, so it never rounds up to
    a whole number; the dividend is named once, which keeps nested expressions small.
    """
    return F.floor(a.cast("decimal(20,0)") / F.lit(Decimal(b))).cast("long")


def duration(years: Column | int = 0, months: Column | int = 0, nanos: Column | int = 0) -> Typed:
    part = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return Typed(F.struct(part(years).alias("years"), part(months).alias("months"), part(nanos).alias("nanos")), DURATION)
