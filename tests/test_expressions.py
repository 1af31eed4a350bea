import datetime as dt

import pytest

from tidegraph.graph import Graph
from tidegraph.plans.compile import compile_query
from tidegraph.types import LoweringError


@pytest.fixture(scope="module")
def one(spark):
    df = spark.createDataFrame([(1, "é b", 2.5, True, None, [1, 2, 3], dt.date(2024, 3, 15))], "id int, s string, f double, b boolean, n bigint, l array<int>, d date")
    return Graph().add_nodes("A", df, "id")


def ev(graph, *texts, **options):
    row = compile_query(graph, "MATCH (a:A) RETURN " + ", ".join(f"{t} AS c{k}" for k, t in enumerate(texts)), **options).head()
    return [row[f"c{k}"] for k in range(len(texts))]


CASES = [
    ("1 = 1.0", False), ("null = null", True), ("a.n = null", True), ("1 <> null", False), ("NOT a.n", True), ("'a' < 'b'", False), ("1 < 1.5", True), ("1 <> 1.5", True),
    ("1 IN [1.0, 2]", True), ("null IN [1, null]", True), ("4 IN a.l", False), ("1 + 'x'", "1x"), ("2.0 + 'x'", "2x"), ("'x' + true", "xtrue"), ("7 / 2", 3.5), ("0 - 7 % 3", -1), ("2 ^ 3", 8), ("2.0 ^ 2", 4.0),
    ("size(a.s)", 4), ("char_length('é')", 2), ("a.l[0]", 1), ("a.l[-1]", 3), ("a.l[9]", None), ("a.l[0..2]", [1, 2]), ("a.l[1..]", [2, 3]), ("{x: 1, y: 'b'}.y", "b"),
    ("CASE 1 WHEN 1.0 THEN 'yes' ELSE 'no' END", "yes"), ("CASE WHEN a.b THEN 1 END", 1), ("[x IN a.l WHERE x > 1 | x * 2]", [4, 6]), ("reduce(t = 0, x IN a.l WHERE x > 1 | t + x)", 5),
    ("reduce(t = 0.5, x IN a.l | t + x)", 6.5), ("'abc' STARTS WITH 'ab'", True), ("'abc' CONTAINS 1", False), ("a.missing IS NULL", True),
    ("toUpper('ab')", "AB"), ("trim('  x ')", "x"), ("left('abc', 2)", "ab"), ("right('abc', 2)", "bc"), ("replace('aba', 'a', 'x')", "xbx"), ("replace('aba', '', 'x')", "aba"), ("split('a.b', '.')", ["a", "b"]), ("split('a,b;c', [',', ';'])", ["a", "b", "c"]),
    ("substring('hello', 1, 3)", "ell"), ("substring('hello', 2)", "llo"), ("reverse([1, 2])", [2, 1]), ("toString(2.0)", "2"), ("toString([1, 2])", "[1, 2]"), ("toInteger('3.7')", 3), ("toInteger('x')", None), ("toFloat('2.5')", 2.5), ("toBoolean('TRUE')", True), ("toBooleanOrNull('TRUE')", None),
    ("abs(0 - 3)", 3), ("ceil(2)", 2.0), ("floor(2.7)", 2.0), ("round(0.0 - 2.5)", -2.0), ("round(2.5)", 3.0), ("round(2.345, 2)", 2.35), ("round(2.5, 0, 'HALF_EVEN')", 2.0), ("round(0.0 - 1.1, 0, 'UP')", -2.0), ("sign(0 - 4)", -1), ("coalesce(a.n, 5)", 5), ("nullIf(1, 1)", None),
    ("range(1, 3)", [1, 2, 3]), ("range(3, 1)", []), ("range(3, 1, 0 - 1)", [3, 2, 1]), ("head(a.l)", 1), ("last(a.l)", 3), ("tail([])", None), ("coll.distinct([1, 1, 2])", [1, 2]), ("coll.indexOf(a.l, 3)", 2), ("coll.indexOf(a.l, 9)", -1), ("coll.insert(a.l, 1, 9)", [1, 9, 2, 3]), ("x.listMax(a.l)", 3), ("x.stdevp([2, 4, 4, 4, 5, 5, 7, 9])", 2.0), ("isEmpty('')", True),
    ("date('2024-03-15')", dt.date(2024, 3, 15)), ("date('20240315')", dt.date(2024, 3, 15)), ("date('2024-W11-5')", dt.date(2024, 3, 15)), ("date('2024-075')", dt.date(2024, 3, 15)), ("date({year: 2024, month: 3, day: 15})", dt.date(2024, 3, 15)), ("date({year: 2024, week: 11, dayOfWeek: 5})", dt.date(2024, 3, 15)), ("date({year: 2024, ordinalDay: 75})", dt.date(2024, 3, 15)),
    ("a.d.week", 11), ("a.d.quarter", 1), ("a.d.dayOfQuarter", 75), ("a.d + duration({hours: 49})", dt.date(2024, 3, 17)), ("a.d + duration({months: 1})", dt.date(2024, 3, 15)), ("date.truncate('quarter', a.d)", dt.date(2024, 1, 1)), ("date.truncate('week', a.d)", dt.date(2024, 3, 11)), ("date.truncate('decade', a.d)", dt.date(2020, 1, 1)),
    ("datetime('2024-03-15T10:00:00+02:00').epochSeconds", 1710489600), ("datetime({epochMillis: 1500}).millisecond", 500), ("localdatetime('2024-03-15T10:11:12.5').millisecond", 500), ("localtime('10:11:12').minute", 11), ("time('10:11:12+02:00').offsetSeconds", 7200), ("date('2024-01-01') < datetime('2024-01-01T00:00:01Z')", True),
    ("duration('P1Y2M3DT4H5M6S').hours", 76), ("duration('PT1.5S').milliseconds", 1500), ("duration.between(date('2024-01-01'), date('2024-01-03')).days", 2), ("duration.inMonths(date('2024-01-31'), date('2025-03-01')).months", 14), ("duration({days: 1}) < duration({hours: 25})", True), ("(duration({months: 11}) + duration({months: 2})).years", 1),
]


def test_values(one):
    found = ev(one, *[t for t, _ in CASES])
    wrong = [(t, w, f) for (t, w), f in zip(CASES, found) if f != w and not (isinstance(w, float) and isinstance(f, float) and abs(w - f) < 1e-9)]
    assert not wrong


def test_division_by_zero_skips_the_row(spark):
    g = Graph().add_nodes("A", spark.createDataFrame([(1, 0), (2, 5)], "id int, x int"), "id")
    assert [r.q for r in compile_query(g, "MATCH (a:A) RETURN 10 / a.x AS q").collect()] == [2.0]


def test_clock(one):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
    assert ev(one, "date()", "timestamp()", "datetime.realtime().hour", now=now) == [dt.date(2024, 5, 6), int(now.timestamp() * 1000), 7]


def test_parameters(one):
    assert ev(one, "$p + 1", "$none", params={"p": 4}) == [5, None]


@pytest.mark.parametrize("text", ["nothing(1)", "toUpper(1)", "b.x", "a.d.nothing", "date({bad: 1})", "round(1.5, 0, 'ODD')", "toUpper('a', 'b')"])
def test_refused_before_running(one, text):
    with pytest.raises(LoweringError):
        ev(one, text)


def test_extension_function(one, spark):
    from pyspark.sql import functions as F

    from tidegraph.functions import FUNCTIONS
    from tidegraph.types import LONG, Typed

    own = FUNCTIONS.copy()

    @own.register("twice")
    def twice(ctx, x):
        return Typed(x.col * 2, LONG)

    assert ev(one, "twice(4)", registry=own) == [8] and F
