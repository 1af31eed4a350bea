"""Dates, times and durations.

Instants are Spark dates and timestamps; a local time is a struct of nanoseconds of
the day, a zoned time adds its offset.  ``datetime`` values are instants in UTC and
show UTC fields.  Spark keeps microseconds.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions.registry import FUNCTIONS, need
from tidegraph.types import (
    DATE,
    DATETIME,
    DAY_NS,
    DURATION,
    INSTANTS,
    LOCAL_DATETIME,
    LOCAL_TIME,
    LONG,
    SECOND_NS,
    STRING,
    ZONED_TIME,
    LoweringError,
    Typed,
    duration,
    epoch_nanos,
    floor_div,
    is_number,
)

HOUR_NS, MINUTE_NS = 3600 * SECOND_NS, 60 * SECOND_NS
_DATE_KEYS = {"year", "month", "day", "week", "dayOfWeek", "ordinalDay", "quarter", "dayOfQuarter"}
_TIME_KEYS = {"hour", "minute", "second", "millisecond", "microsecond", "nanosecond"}


# -- reading text


def iso_date(s: Column) -> Column:
    """Calendar, week, quarter and ordinal dates, with or without dashes; null if none of them."""
    d = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    d = F.regexp_replace(d, r"^(\d{4})(\d{2})$", "$1-$2")
    year = F.substring(s, 1, 4).try_cast("int")
    part = lambda pattern, g: F.regexp_extract(s, pattern, g).try_cast("int")
    week, quarter, ordinal = r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", r"^(\d{4})-?Q(\d)(?:-?(\d{2}))?$", r"^(\d{4})-?(\d{3})$"
    return (
        F.when(s.rlike(week), week_date(year, part(week, 2), F.coalesce(part(week, 3), F.lit(1))))
        .when(s.rlike(quarter), F.date_add(F.make_date(year, (part(quarter, 2) - 1) * 3 + 1, F.lit(1)), F.coalesce(part(quarter, 3), F.lit(1)) - 1))
        .when(s.rlike(ordinal), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), part(ordinal, 2) - 1))
        .otherwise(d.try_cast("date"))
    )


def week_date(year: Column, week: Column, day: Column) -> Column:
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(fourth, (week - 1) * 7 + (day - 1) - F.weekday(fourth)).cast("date")


_CLOCK = r"^(\d{2}):?(\d{2})?:?(\d{2})?(?:\.(\d{1,9}))?"


def iso_nanos_of_day(s: Column) -> Column:
    part = lambda g: F.coalesce(F.regexp_extract(s, _CLOCK, g).try_cast("long"), F.lit(0).cast("long"))
    fraction = F.rpad(F.regexp_extract(s, _CLOCK, 4), 9, "0").try_cast("long")
    return F.when(s.rlike(_CLOCK), part(1) * HOUR_NS + part(2) * MINUTE_NS + part(3) * SECOND_NS + F.coalesce(fraction, F.lit(0)))


_OFFSET = r"([+-])(\d{2}):?(\d{2})?(?:\[.*\])?$"


def offset_seconds(s: Column) -> Column:
    size = F.regexp_extract(s, _OFFSET, 2).try_cast("long") * 3600 + F.coalesce(F.regexp_extract(s, _OFFSET, 3).try_cast("long"), F.lit(0)) * 60
    return F.when(s.rlike(_OFFSET), F.when(F.regexp_extract(s, _OFFSET, 1) == "-", -size).otherwise(size)).otherwise(F.lit(0)).cast("long")


def ntz(date: Column, nanos: Column) -> Column:
    micros = F.unix_date(date).cast("long") * 86_400_000_000 + floor_div(nanos, 1000)
    return from_micros(micros)


def from_micros(micros: Column) -> Column:
    """Local date and time that many microseconds after 1970, whatever the session's zone."""
    day = floor_div(micros, 86_400_000_000).cast("int")
    rest = micros - day.cast("long") * 86_400_000_000
    date = F.date_from_unix_date(day)
    sec = (rest % 60_000_000).cast("decimal(16,6)") / F.lit(1_000_000).cast("decimal(16,6)")
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.day(date), F.floor(rest / 3_600_000_000).cast("int"), (F.floor(rest / 60_000_000) % 60).cast("int"), sec.cast("decimal(16,6)"))


def iso_local_datetime(s: Column) -> Column:
    date, time = F.split_part(s, F.lit("T"), F.lit(1)), F.split_part(s, F.lit("T"), F.lit(2))
    return ntz(iso_date(date), F.when(time == "", F.lit(0).cast("long")).otherwise(iso_nanos_of_day(time)))


def iso_datetime(s: Column) -> Column:
    time = F.split_part(s, F.lit("T"), F.lit(2))
    region = F.regexp_extract(s, r"\[(.+)\]$", 1)
    plain = F.regexp_replace(s, r"(?:Z|[+-]\d{2}(?::?\d{2})?)?(?:\[.+\])?$", "")
    bare = F.when(s.contains("T"), plain).otherwise(s)
    micros = floor_div(epoch_nanos(Typed(iso_local_datetime(bare), LOCAL_DATETIME)), 1000)
    shifted = F.timestamp_micros((micros - offset_seconds(F.when(s.contains("T"), time).otherwise(F.lit(""))) * 1_000_000).cast("long"))
    zoned = F.to_utc_timestamp(F.timestamp_micros(micros.cast("long")), region)
    return F.when((region != "") & ~s.rlike(r"[+-]\d{2}:?\d{0,2}\["), zoned).otherwise(shifted)


# -- from components


def _ints(fields: dict[str, Typed], key: str, default: int) -> Column:
    return fields[key].col.cast("int") if key in fields else F.lit(default)


def _date_of(name: str, f: dict[str, Typed]) -> Column:
    if unknown := set(f) - _DATE_KEYS - _TIME_KEYS - {"timezone", "epochSeconds", "epochMillis"}:
        raise LoweringError(f"{name}: unknown component {', '.join(sorted(unknown))}")
    year = _ints(f, "year", 1970)
    if "week" in f:
        return week_date(year, _ints(f, "week", 1), _ints(f, "dayOfWeek", 1))
    if "ordinalDay" in f:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), _ints(f, "ordinalDay", 1) - 1)
    if "quarter" in f:
        return F.date_add(F.make_date(year, (_ints(f, "quarter", 1) - 1) * 3 + 1, F.lit(1)), _ints(f, "dayOfQuarter", 1) - 1)
    return F.make_date(year, _ints(f, "month", 1), _ints(f, "day", 1))


def _nanos_of(f: dict[str, Typed]) -> Column:
    unit = {"hour": HOUR_NS, "minute": MINUTE_NS, "second": SECOND_NS, "millisecond": 1_000_000, "microsecond": 1000, "nanosecond": 1}
    return sum((f[k].col.cast("long") * n for k, n in unit.items() if k in f), F.lit(0).cast("long"))


def _epoch_micros(f: dict[str, Typed]) -> Column | None:
    if "epochSeconds" in f:
        return f["epochSeconds"].col.cast("long") * 1_000_000
    return f["epochMillis"].col.cast("long") * 1000 if "epochMillis" in f else None


def _zone_offset(f: dict[str, Typed]) -> Column:
    return offset_seconds(f["timezone"].col) if "timezone" in f else F.lit(0).cast("long")


_PLAIN = re.compile(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?")


def _plain_literal(text: object, kind) -> Column | None:
    """A literal text in the usual form as a literal: the expression that reads any text is large."""
    if not isinstance(text, str) or not _PLAIN.fullmatch(text) or kind not in (DATE, DATETIME, LOCAL_DATETIME) or (kind == DATE) != (len(text) == 10):
        return None
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    if kind == DATE:
        return F.lit(at.date())
    if kind == LOCAL_DATETIME and at.tzinfo is not None:
        return None
    since = at.replace(tzinfo=at.tzinfo or dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    micros = F.lit(since // dt.timedelta(microseconds=1)).cast("long")
    return F.timestamp_micros(micros) if kind == DATETIME else from_micros(micros)


def _maker(names: tuple[str, ...], kind, now, from_text, from_fields, from_other) -> None:
    @FUNCTIONS.register(*names)
    def build(ctx, x: Typed | None = None) -> Typed:
        if x is None:
            return Typed(now(ctx.wall), kind)
        if x.fields:
            return Typed(from_fields(x.fields), kind)
        if x.type == STRING:
            known = _plain_literal(x.literal, kind)
            return Typed(from_text(x.col) if known is None else known, kind)
        if x.type == kind:
            return x
        found = from_other(x)
        need(found is not None, names[0], "text, components or an instant")
        return Typed(found, kind)


def _struct_time(nanos: Column) -> Column:
    return F.when(nanos.isNotNull(), F.struct(nanos.cast("long").alias("nanos_of_day")))


def _struct_zoned(nanos: Column, offset: Column) -> Column:
    return F.when(nanos.isNotNull(), F.struct(nanos.cast("long").alias("nanos_of_day"), offset.cast("long").alias("offset_s")))


def _utc_micros(wall: Column) -> Column:
    return F.unix_micros(wall)


def _day_nanos(micros: Column) -> Column:
    return F.pmod(micros, F.lit(86_400_000_000)) * 1000


def _date_from(x: Typed) -> Column | None:
    if x.type == LOCAL_DATETIME:
        return x.col.cast("date")
    return F.date_from_unix_date(F.floor(F.unix_micros(x.col) / 86_400_000_000).cast("int")) if x.type == DATETIME else None


def _datetime_fields(f: dict[str, Typed]) -> Column:
    if (micros := _epoch_micros(f)) is not None:
        return F.timestamp_micros(micros)
    local = F.unix_date(_date_of("datetime", f)).cast("long") * 86_400_000_000 + floor_div(_nanos_of(f), 1000)
    if "timezone" in f and not str(f["timezone"].literal or "").startswith(("+", "-", "Z")):
        return F.to_utc_timestamp(F.timestamp_micros(local), f["timezone"].col)
    return F.timestamp_micros(local - _zone_offset(f) * 1_000_000)


def _date_fields(f: dict[str, Typed]) -> Column:
    if (micros := _epoch_micros(f)) is not None:
        return F.date_from_unix_date(F.floor(micros / 86_400_000_000).cast("int"))
    return _date_of("date", f)


def _local_datetime_fields(f: dict[str, Typed]) -> Column:
    micros = _epoch_micros(f)
    return from_micros(micros) if micros is not None else ntz(_date_of("localdatetime", f), _nanos_of(f))


_maker(("date",), DATE, lambda w: F.date_from_unix_date(F.floor(_utc_micros(w) / 86_400_000_000).cast("int")), iso_date, _date_fields, _date_from)
_maker(("localtime", "local_time"), LOCAL_TIME, lambda w: _struct_time(_day_nanos(_utc_micros(w))), lambda s: _struct_time(iso_nanos_of_day(s)), lambda f: _struct_time(_nanos_of(f)), lambda x: _struct_time(F.pmod(epoch_nanos(x), F.lit(DAY_NS))) if x.type in (LOCAL_DATETIME, DATETIME, ZONED_TIME) else None)
_maker(("localdatetime", "local_datetime"), LOCAL_DATETIME, lambda w: from_micros(_utc_micros(w)), iso_local_datetime, _local_datetime_fields, lambda x: from_micros(floor_div(epoch_nanos(x), 1000)) if x.type in (DATE, DATETIME) else None)
_maker(("time", "zoned_time"), ZONED_TIME, lambda w: _struct_zoned(_day_nanos(_utc_micros(w)), F.lit(0)), lambda s: _struct_zoned(iso_nanos_of_day(s), offset_seconds(s)), lambda f: _struct_zoned(_nanos_of(f), _zone_offset(f)), lambda x: _struct_zoned(F.pmod(epoch_nanos(x), F.lit(DAY_NS)), F.lit(0)) if x.type in (LOCAL_TIME, LOCAL_DATETIME, DATETIME) else None)
_maker(("datetime", "zoned_datetime"), DATETIME, lambda w: w, iso_datetime, _datetime_fields, lambda x: F.timestamp_micros(floor_div(epoch_nanos(x), 1000)) if x.type in (DATE, LOCAL_DATETIME) else None)


# -- clocks

_FROM_CLOCK = {"date": "date", "localtime": "localtime", "localdatetime": "localdatetime", "time": "time", "datetime": "datetime"}


def _clock(kind: str, clock: str) -> None:
    @FUNCTIONS.register(f"{kind}.{clock}")
    def build(ctx, zone: Typed | None = None) -> Typed:
        at = ctx.transaction if clock == "transaction" else ctx.realtime
        if zone is not None and kind in ("date", "localtime"):
            at = F.from_utc_timestamp(at, zone.col)
        return FUNCTIONS.known[_FROM_CLOCK[kind]](ctx, Typed(at, DATETIME)) if kind != "date" else Typed(_date_from(Typed(at, DATETIME)), DATE)


for _kind in _FROM_CLOCK:
    for _name in ("transaction", "statement", "realtime"):
        _clock(_kind, _name)


# -- truncation

_YEARS = {"millennium": 1000, "century": 100, "decade": 10, "year": 1}


def _truncate_date(unit: str, d: Column) -> Column:
    year = F.year(d)
    if unit in _YEARS:
        return F.make_date((year - year % _YEARS[unit]).cast("int"), F.lit(1), F.lit(1))
    if unit == "quarter":
        return F.make_date(year, (F.quarter(d) - 1) * 3 + 1, F.lit(1))
    if unit == "month":
        return F.make_date(year, F.month(d), F.lit(1))
    if unit == "week":
        return F.date_sub(d, F.weekday(d))
    if unit == "weekyear":
        return week_date(F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.lit(1), F.lit(1))
    if unit == "day":
        return d
    raise LoweringError(f"cannot truncate a date to {unit}")


_TIME_UNITS = {"day": DAY_NS, "hour": HOUR_NS, "minute": MINUTE_NS, "second": SECOND_NS, "millisecond": 1_000_000, "microsecond": 1000}


def _override_date(d: Column, f: dict[str, Typed]) -> Column:
    if not set(f) & _DATE_KEYS:
        return d
    if "dayOfWeek" in f:
        d = F.date_add(F.date_sub(d, F.weekday(d)), _ints(f, "dayOfWeek", 1) - 1)
    year, month, day = (f[k].col.cast("int") if k in f else g(d) for k, g in (("year", F.year), ("month", F.month), ("day", F.day)))
    return F.make_date(year, month, day) if set(f) & {"year", "month", "day"} else d


def _truncate(kind: str) -> None:
    @FUNCTIONS.register(f"{kind}.truncate")
    def build(ctx, unit: Typed, x: Typed | None = None, more: Typed | None = None) -> Typed:
        name = str(unit.literal)
        target = {"date": DATE, "time": ZONED_TIME, "datetime": DATETIME, "localtime": LOCAL_TIME, "localdatetime": LOCAL_DATETIME}[kind]
        x = FUNCTIONS.known[kind](ctx) if x is None else x
        need(x.type in INSTANTS, f"{kind}.truncate", "an instant")
        f = more.fields if more is not None else {}
        if target in (LOCAL_TIME, ZONED_TIME):
            need(name in _TIME_UNITS, f"{kind}.truncate", "a unit of time")
            n = F.pmod(epoch_nanos(x) if x.type != ZONED_TIME else x.col["nanos_of_day"], F.lit(DAY_NS))
            n = n - n % _TIME_UNITS[name] + _nanos_of(f)
            offset = x.col["offset_s"] if x.type == ZONED_TIME else F.lit(0)
            return Typed(_struct_time(n) if target == LOCAL_TIME else _struct_zoned(n, offset), target)
        nanos = epoch_nanos(x)
        day = F.date_from_unix_date(floor_div(nanos, DAY_NS).cast("int"))
        rest = F.lit(0).cast("long")
        if name in _TIME_UNITS and name != "day":
            rest = F.pmod(nanos, F.lit(DAY_NS))
            rest = rest - rest % _TIME_UNITS[name]
        else:
            day = _truncate_date(name, day)
        day, rest = _override_date(day, f), rest + _nanos_of(f)
        if target == DATE:
            return Typed(day, DATE)
        micros = F.unix_date(day).cast("long") * 86_400_000_000 + floor_div(rest, 1000)
        return Typed(F.timestamp_micros(micros) if target == DATETIME else from_micros(micros), target)


for _kind in _FROM_CLOCK:
    _truncate(_kind)


# -- durations

_UNITS = {"weeks": 7 * DAY_NS, "days": DAY_NS, "hours": HOUR_NS, "minutes": MINUTE_NS, "seconds": SECOND_NS, "milliseconds": 1_000_000, "microseconds": 1000, "nanoseconds": 1}
_ISO = r"^P(?:([\d.]+)Y)?(?:([\d.]+)M)?(?:([\d.]+)W)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?$"


def _from_parts(years: Column, months: Column, nanos: Column) -> Typed:
    """Fractions of years and months cascade to months and (30-day) days."""
    months = months + (years - F.floor(years)) * 12
    nanos = nanos + (months - F.floor(months)) * 30 * DAY_NS
    return duration(F.floor(years), F.floor(months), F.round(nanos))


@FUNCTIONS.register("duration")
def make_duration(ctx, x: Typed) -> Typed:
    if x.type == DURATION:
        return x
    if x.fields:
        if unknown := set(x.fields) - set(_UNITS) - {"years", "months", "quarters"}:
            raise LoweringError(f"duration: unknown component {', '.join(sorted(unknown))}")
        of = lambda k: x.fields[k].col.cast("double") if k in x.fields else F.lit(0.0)
        whole = all(x.fields[k].type == LONG for k in x.fields)
        if whole:
            exact = lambda k: x.fields[k].col if k in x.fields else F.lit(0).cast("long")
            return duration(exact("years"), exact("months") + exact("quarters") * 3, sum((exact(k) * n for k, n in _UNITS.items()), F.lit(0).cast("long")))
        return _from_parts(of("years"), of("months") + of("quarters") * 3, sum((of(k) * n for k, n in _UNITS.items()), F.lit(0.0)))
    need(x.type == STRING, "duration", "text or components")
    part = lambda g: F.coalesce(F.regexp_extract(x.col, _ISO, g).try_cast("double"), F.lit(0.0))
    nanos = part(3) * 7 * DAY_NS + part(4) * DAY_NS + part(5) * HOUR_NS + part(6) * MINUTE_NS + part(7) * SECOND_NS
    found = _from_parts(part(1), part(2), nanos)
    return Typed(F.when(x.col.rlike(_ISO), found.col).when(x.col.isNotNull(), F.raise_error(F.concat(F.lit("not a duration: "), x.col)).cast(DURATION)), DURATION)


def _both(name: str, a: Typed, b: Typed) -> None:
    need(a.type in INSTANTS and b.type in INSTANTS, name, "two instants")


def _line(a: Typed, b: Typed) -> Column:
    """Nanoseconds from a to b; where one has no date, only clocks are compared."""
    clock = a.type in (LOCAL_TIME, ZONED_TIME) or b.type in (LOCAL_TIME, ZONED_TIME)
    of = (lambda x: F.pmod(epoch_nanos(x), F.lit(DAY_NS))) if clock else epoch_nanos
    return of(b) - of(a)


@FUNCTIONS.register("duration.between", "duration_between")
def between(ctx, a: Typed, b: Typed) -> Typed:
    _both("duration.between", a, b)
    return duration(0, 0, _line(a, b))


@FUNCTIONS.register("duration.inMonths")
def in_months(ctx, a: Typed, b: Typed) -> Typed:
    _both("duration.inMonths", a, b)
    if {a.type, b.type} & {LOCAL_TIME, ZONED_TIME} or not {a.type, b.type} <= {DATE, LOCAL_DATETIME, DATETIME}:
        return duration()
    day = lambda x: x.col if x.type == DATE else _date_from(x)
    months = (F.year(day(b)) - F.year(day(a))) * 12 + F.month(day(b)) - F.month(day(a))
    return duration((months / 12).cast("long"), months - (months / 12).cast("long") * 12, 0)


@FUNCTIONS.register("duration.inDays")
def in_days(ctx, a: Typed, b: Typed) -> Typed:
    _both("duration.inDays", a, b)
    return duration(0, 0, _line(a, b) - _line(a, b) % DAY_NS)


@FUNCTIONS.register("duration.inSeconds")
def in_seconds(ctx, a: Typed, b: Typed) -> Typed:
    _both("duration.inSeconds", a, b)
    return duration(0, 0, _line(a, b) - _line(a, b) % SECOND_NS)


def length_nanos(x: Typed) -> Column:
    """A duration as nanoseconds, months taken as 30 days; numbers are milliseconds."""
    if is_number(x.type):
        return x.col.cast("long") * 1_000_000
    need(x.type == DURATION, "a span of time", "a duration or milliseconds")
    return (x.col["years"] * 12 + x.col["months"]) * (30 * DAY_NS) + x.col["nanos"]


def epoch_millis(x: Typed) -> Column:
    """An instant, or a number of milliseconds, as milliseconds since 1970."""
    return x.col.cast("long") if is_number(x.type) else floor_div(epoch_nanos(x), 1_000_000)


# -- fields of temporal values

_DATE_FIELDS = {
    "year": F.year,
    "month": F.month,
    "day": F.day,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "dayOfWeek": lambda d: F.weekday(d) + 1,
    "weekDay": lambda d: F.weekday(d) + 1,
    "ordinalDay": F.dayofyear,
    "weekYear": lambda d: F.extract(F.lit("YEAROFWEEK"), d),
    "dayOfQuarter": lambda d: F.datediff(d, F.trunc(d, "quarter")) + 1,
    "quarterDay": lambda d: F.datediff(d, F.trunc(d, "quarter")) + 1,
}
_TIME_FIELDS = {
    "hour": lambda n: n / HOUR_NS,
    "minute": lambda n: n / MINUTE_NS % 60,
    "second": lambda n: n / SECOND_NS % 60,
    "millisecond": lambda n: n % SECOND_NS / 1_000_000,
    "microsecond": lambda n: n % SECOND_NS / 1000,
    "nanosecond": lambda n: n % SECOND_NS,
}
_DURATION_TOTALS = {"weeks": 7 * DAY_NS, "days": DAY_NS, "hours": HOUR_NS, "minutes": MINUTE_NS, "seconds": SECOND_NS, "milliseconds": 1_000_000, "microseconds": 1000, "nanoseconds": 1}
_DURATION_PARTS = {"monthsOfYear": None, "monthsOfQuarter": None, "quartersOfYear": None, "daysOfWeek": (DAY_NS, 7), "minutesOfHour": (MINUTE_NS, 60), "secondsOfMinute": (SECOND_NS, 60), "millisecondsOfSecond": (1_000_000, 1000), "microsecondsOfSecond": (1000, 1_000_000), "nanosecondsOfSecond": (1, SECOND_NS)}


def temporal_field(x: Typed, key: str) -> Typed | None:
    """A field of a temporal value; None if ``x`` is no temporal value."""
    t = x.type
    whole = lambda c: Typed(F.floor(c).cast("long"), LONG)
    if t == DURATION:
        n, months = x.col["nanos"], x.col["years"] * 12 + x.col["months"]
        if key == "years":
            return whole(x.col["years"] + F.floor(x.col["months"] / 12) + (n / DAY_NS / 365).cast("long"))
        if key in ("months", "quarters"):
            return whole(months / (1 if key == "months" else 3))
        if key in _DURATION_TOTALS:
            return Typed((n / _DURATION_TOTALS[key]).cast("long"), LONG)
        if key in _DURATION_PARTS:
            if key.startswith("months"):
                return whole(months % (12 if key == "monthsOfYear" else 3))
            if key.startswith("quarters"):
                return whole(F.floor(months / 3) % 4)
            unit, size = _DURATION_PARTS[key]
            return Typed((n / unit).cast("long") % size, LONG)
        raise LoweringError(f"a duration has no {key}")
    if t not in INSTANTS:
        return None
    if key in _DATE_FIELDS and t in (DATE, LOCAL_DATETIME, DATETIME):
        day = x.col if t == DATE else _date_from(x)
        return Typed(_DATE_FIELDS[key](day).cast("long"), LONG)
    if key in _TIME_FIELDS and t != DATE:
        n = x.col["nanos_of_day"] if t in (LOCAL_TIME, ZONED_TIME) else F.pmod(epoch_nanos(x), F.lit(DAY_NS))
        return whole(_TIME_FIELDS[key](n))
    if t == DATETIME and key in ("epochMillis", "epochSeconds"):
        return Typed(F.unix_millis(x.col) if key == "epochMillis" else F.unix_seconds(x.col), LONG)
    offset = x.col["offset_s"] if t == ZONED_TIME else F.lit(0).cast("long") if t == DATETIME else None
    if offset is not None:
        if key in ("offset", "timezone"):
            size = F.abs(offset)
            return Typed(F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(size / 3600), F.floor(size % 3600 / 60)), STRING)
        if key in ("offsetSeconds", "offsetMinutes"):
            return whole(offset / (1 if key == "offsetSeconds" else 60))
    raise LoweringError(f"{t.simpleString()} has no {key}")


def shift(x: Typed, by: Typed, sign: int) -> Typed | None:
    """Instant plus or minus a duration: its clock part only, and whole days of it for dates."""
    n = by.col["nanos"] * sign
    if x.type == DATE:
        return Typed(F.date_add(x.col, (n / DAY_NS).cast("int")), DATE)
    if x.type == LOCAL_DATETIME:
        return Typed(from_micros(floor_div(epoch_nanos(x) + n, 1000)), LOCAL_DATETIME)
    if x.type == DATETIME:
        return Typed(F.timestamp_micros(F.unix_micros(x.col) + floor_div(n, 1000)), DATETIME)
    if x.type == LOCAL_TIME:
        return Typed(_struct_time(F.pmod(x.col["nanos_of_day"] + n, F.lit(DAY_NS))), LOCAL_TIME)
    if x.type == ZONED_TIME:
        return Typed(_struct_zoned(F.pmod(x.col["nanos_of_day"] + n, F.lit(DAY_NS)), x.col["offset_s"]), ZONED_TIME)
    return None


def add_durations(a: Typed, b: Typed, sign: int) -> Typed:
    months = a.col["years"] * 12 + a.col["months"] + (b.col["years"] * 12 + b.col["months"]) * sign
    return duration(F.floor(months / 12), F.pmod(months, F.lit(12)), a.col["nanos"] + b.col["nanos"] * sign)


