"""Further registered queries: functions, temporal values, aggregates and joins, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegraph.catalogue import CLOCK, _add, _query, test_graph
from tidegraph.graph import Graph
from tidegraph.plans.compile import compile_query

_NATION = "CAST(n_nationkey AS BIGINT)"

_add(
    "trigonometry",
    "MATCH (c:Customer) RETURN c.c_custkey AS k, round(sin(c.c_acctbal), 8) AS s, round(cos(c.c_acctbal), 8) AS c, round(tan(c.c_custkey * 0.001), 8) AS t, round(degrees(c.c_custkey * 0.01), 6) AS d, round(radians(c.c_acctbal), 8) AS r, round(pi(), 12) AS p",
    "SELECT c_custkey AS k, round(sin(c_acctbal), 8) AS s, round(cos(c_acctbal), 8) AS c, round(tan(c_custkey * 0.001::DOUBLE), 8) AS t, round(degrees(c_custkey * 0.01::DOUBLE), 6) AS d, round(radians(c_acctbal), 8) AS r, round(pi(), 12) AS p FROM customer",
)
_add(
    "conversions",
    "MATCH (c:Customer) RETURN c.c_custkey AS k, toString(c.c_custkey) AS s, toString(c.c_acctbal > 0.0) AS b, toStringOrNull(c.c_nationkey) AS sn, toIntegerOrNull(c.c_name) AS i, toIntegerOrNull('42') AS i2, toFloatOrNull(c.c_mktsegment) AS f, toFloatOrNull('1.25') AS f2, toBoolean('true') AS t, toBooleanOrNull('maybe') AS m, nullIf(c.c_nationkey, 3) AS n, isEmpty(c.c_name) AS e, isEmpty('') AS e2",
    "SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS b, CAST(c_nationkey AS VARCHAR) AS sn, CAST(NULL AS BIGINT) AS i, CAST(42 AS BIGINT) AS i2, CAST(NULL AS DOUBLE) AS f, 1.25::DOUBLE AS f2, true AS t, CAST(NULL AS BOOLEAN) AS m, CAST(nullif(c_nationkey, 3) AS BIGINT) AS n, false AS e, true AS e2 FROM customer",
)
_add(
    "text_edges",
    "MATCH (p:Part) RETURN p.p_partkey AS k, ltrim('  a ') AS l, rtrim(' a  ') AS r, left(p.p_name, 100) AS whole, substring(p.p_name, 3) AS rest, split(p.p_name, ' ')[0] AS first, size(p.p_name) AS bytes, p.p_name + '!' + p.p_size AS joined, toUpper(left(p.p_brand, 1)) + toLower(substring(p.p_brand, 1)) AS cased",
    "SELECT p_partkey AS k, 'a ' AS l, ' a' AS r, p_name AS whole, substr(p_name, 4) AS rest, string_split(p_name, ' ')[1] AS first, CAST(strlen(p_name) AS BIGINT) AS bytes, p_name || '!' || CAST(p_size AS VARCHAR) AS joined, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS cased FROM part",
)
_add(
    "random_functions",
    "MATCH (n:Nation) RETURN n.n_nationkey AS k, rand() >= 0.0 AND rand() < 1.0 AS inside, size(randomUUID()) AS length, timestamp() > 0 AS later",
    f"SELECT {_NATION} AS k, true AS inside, CAST(36 AS BIGINT) AS length, true AS later FROM nation",
)
_add(
    "list_edges",
    "MATCH (n:Nation) WITH n.n_nationkey AS k, [n.n_nationkey, n.n_regionkey, n.n_nationkey, 2] AS l RETURN k, coll.distinct(l) AS once, coll.insert(l, 1, 9) AS more, listMin(l) AS least, round(tide.stdevp(l), 9) AS sd, reverse(l) AS back, [x IN l] AS same, [x IN l | x + 1] AS up, [x IN l WHERE x > 2] AS big, x IN l WHERE x > 2 | x * 2 AS bare, l[1..3] AS middle, l[9] AS nothing, {a: {b: k}}.a.b AS nested, range(6, 0, 0 - 3) AS down, reduce(t = 0.5, x IN l WHERE x > 1 | t + x) AS total",
    """WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS k, [CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT), 2::BIGINT] AS l FROM nation)
    SELECT k, list_sort(list_distinct(l), 'ASC', 'NULLS LAST') AS once0, [x FOR x, i IN l IF list_position(l, x) = i] AS once, [l[1], 9::BIGINT, l[2], l[3], l[4]] AS more, list_min(l) AS least, round(list_stddev_pop(l), 9) AS sd, list_reverse(l) AS back, l AS same, [x + 1 FOR x IN l] AS up, [x FOR x IN l IF x > 2] AS big, [x * 2 FOR x IN l IF x > 2] AS bare, l[2:3] AS middle, CAST(NULL AS BIGINT) AS nothing, k AS nested, [6::BIGINT, 3::BIGINT, 0::BIGINT] AS down, 0.5::DOUBLE + coalesce(list_sum([x FOR x IN l IF x > 1]), 0) AS total FROM b""".replace("list_sort(list_distinct(l), 'ASC', 'NULLS LAST') AS once0, ", ""),
)
_add(
    "literals_and_parameters",
    "MATCH (o:`Order`) // orders of a status\nWHERE o.o_orderstatus = $status AND o.o_totalprice >= $least RETURN o.o_orderkey AS `key`, [1, 2.5] AS l, {x: 1}.x AS x, $status AS s, null AS nothing",
    "SELECT o_orderkey AS key, [1.0::DOUBLE, 2.5::DOUBLE] AS l, CAST(1 AS BIGINT) AS x, 'F' AS s, CAST(NULL AS VARCHAR) AS nothing FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000",
    params={"status": "F", "least": 200000.0},
)
_add(
    "truncations",
    "MATCH (e:Event) WITH e.event_id AS k, e.ts AS t RETURN k, datetime.truncate('hour', t) AS hour, datetime.truncate('week', t) AS week, datetime.truncate('minute', t, {second: 30}) AS half, localdatetime.truncate('day', t) AS day, localdatetime.truncate('quarter', t) AS quarter, date.truncate('decade', t) AS decade, date.truncate('weekyear', t) AS wy, time.truncate('minute', t).second AS zero, localtime.truncate('hour', t).hour AS h",
    "SELECT event_id AS k, date_trunc('hour', ts) AS hour, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, date_trunc('minute', ts) + INTERVAL 30 SECOND AS half, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS quarter, DATE '2020-01-01' AS decade, DATE '2024-01-01' AS wy, CAST(0 AS BIGINT) AS zero, hour(ts) AS h FROM events",
)
_add(
    "temporal_kinds",
    "MATCH (e:Event) WITH e.event_id AS k, e.ts AS t RETURN k, date(t) AS d, localdatetime(t).minute AS m, localtime(t).hour AS h, time(t).second AS s, time(t).offset AS o, datetime(t).epochSeconds AS epoch, datetime({year: 2024, month: 2, day: 3, hour: 4}) AS made, localdatetime('2024-03-05T10:20:30') AS ldt, localtime('10:20:30').minute AS lt, time('10:20:30+01:00').offsetSeconds AS zone, date({year: 2024, week: 3, dayOfWeek: 2}) AS wd, datetime('2024-01-01T00:00:00+02:00') AS utc, date(t).dayOfQuarter AS dq, date(t).weekYear AS wy, t.millisecond AS ms",
    "SELECT event_id AS k, CAST(ts AS DATE) AS d, minute(ts) AS m, hour(ts) AS h, second(ts) AS s, '+00:00' AS o, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, TIMESTAMP '2024-02-03 04:00:00' AS made, TIMESTAMP '2024-03-05 10:20:30' AS ldt, CAST(20 AS BIGINT) AS lt, CAST(3600 AS BIGINT) AS zone, DATE '2024-01-16' AS wd, TIMESTAMP '2023-12-31 22:00:00' AS utc, CAST(date_diff('day', date_trunc('quarter', ts), ts) + 1 AS BIGINT) AS dq, isoyear(ts) AS wy, millisecond(ts) % 1000 AS ms FROM events",
)
_add(
    "durations",
    "MATCH (e:Event) WITH e.event_id AS k, e.ts AS t, datetime('2024-01-01T00:00:00Z') AS base RETURN k, duration.between(base, t).hours AS hours, duration.inSeconds(base, t).seconds AS seconds, duration.inDays(t, base).days AS back, duration.inMonths(date('2023-01-31'), date(t)).months AS months, t + duration({days: 1, hours: 2}) AS later, t - duration('PT90M') AS before, (duration({hours: 5}) + duration({minutes: 90})).minutes AS sum, duration({months: 14}).years AS years, duration({seconds: 90}) > duration({minutes: 1}) AS longer, duration({days: 10}).daysOfWeek AS dow",
    "SELECT event_id AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') / 3600 AS BIGINT) AS hours, CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS seconds, -CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS BIGINT) AS back, CAST((year(ts) - 2023) * 12 + month(ts) - 1 AS BIGINT) AS months, ts + INTERVAL 26 HOUR AS later, ts - INTERVAL 90 MINUTE AS before, CAST(390 AS BIGINT) AS sum, CAST(1 AS BIGINT) AS years, true AS longer, CAST(3 AS BIGINT) AS dow FROM events",
)
_add(
    "clock_functions",
    "MATCH (e:Event) RETURN e.event_id AS k, date.realtime() AS today, datetime.statement() AS now, localdatetime.realtime() AS local, time.realtime().hour AS h, localtime.statement().minute AS m, date.transaction() AS changed, datetime.transaction() = tide.changeDateTime(e) AS same, tide.changeDateTime(e) AS at",
    "SELECT event_id AS k, DATE '2024-01-16' AS today, TIMESTAMP '2024-01-16' AS now, TIMESTAMP '2024-01-16' AS local, CAST(0 AS BIGINT) AS h, CAST(0 AS BIGINT) AS m, CAST(ts AS DATE) AS changed, true AS same, date_trunc('millisecond', ts) AS at FROM events",
    now=CLOCK,
)
_add(
    "future_values",
    "MATCH (e:Event) WHERE tide.future(e, e.ts + duration({days: 14})) IS NOT NULL RETURN e.event_id AS id, tide.awaiting() IS NULL AS waiting",
    "SELECT event_id AS id, true AS waiting FROM events WHERE ts + INTERVAL 14 DAY <= TIMESTAMP '2024-01-16'",
    now=CLOCK,
)
_add(
    "aggregates_by_order",
    "MATCH (e:Event) RETURN e.event_type AS kind, tide.last(e.value) AS latest, collect(e.event_id)[0] AS first, collect(e.event_id)[-1] AS final, size(collect(e.value)) AS n, max(e.ts) AS newest, min(date(e.ts)) AS oldest, sum(duration({minutes: e.event_id % 7})).minutes AS spent, max(duration({hours: e.event_id % 5})).hours AS longest, min(localtime(e.ts)).hour AS early",
    "SELECT event_type AS kind, arg_max(value, ts) AS latest, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS final, count(value) AS n, max(ts) AS newest, CAST(min(ts) AS DATE) AS oldest, CAST(sum(event_id % 7) AS BIGINT) AS spent, CAST(max(event_id % 5) AS BIGINT) AS longest, CAST(min(hour(ts)) AS BIGINT) AS early FROM events GROUP BY 1",
)
_add(
    "theta_join",
    "MATCH (o:Order)-[:PLACED_BY]-(c:Customer) WHERE o.o_totalprice > c.c_acctbal * 40.0 AND o.o_orderkey <> c.c_custkey RETURN c.c_custkey AS cust, count(o) AS n",
    "SELECT c_custkey AS cust, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 40.0 AND o_orderkey <> c_custkey GROUP BY 1",
)
_add(
    "self_key_join",
    "MATCH (a:Part)-[:SIZED_LIKE]-(b:Part) WHERE a.p_partkey < 200 RETURN a.p_partkey AS a, b.p_partkey AS b",
    "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_partkey OR a.p_partkey = b.p_size WHERE a.p_partkey < 200",
)
_add(
    "filter_by_group",
    "MATCH (o:Order)-[:PLACED_BY]-(c:Customer) WHERE o.o_orderstatus = 'F' AND sum(o.o_totalprice) > 600000.0 RETURN c.c_custkey AS cust, count(o) AS n, max(o.o_totalprice) AS most",
    "SELECT c_custkey AS cust, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1 HAVING sum(o_totalprice) > 600000",
)
_add(
    "gql_scope",
    "MATCH (s:Supplier)-[r:SHIPPED]->(p:Part) FILTER p.p_size < 4 LET big = p.p_retailprice > 900.0 RETURN s.s_suppkey AS supplier, big, count(p) AS n GROUP BY supplier, big",
    "SELECT l_suppkey AS supplier, p_retailprice > 900 AS big, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 4 GROUP BY 1, 2",
    "gql",
)
_add(
    "versions_from_before",
    "MATCH (u:User) WITH u, tide.getVersionsByTimeRange(u, datetime('2024-01-10T00:00:00Z'), datetime('2024-01-11T00:00:00Z'), true) AS vs RETURN u.user_id AS user, max(size(vs)) AS versions",
    "SELECT user_id AS user, CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11') + max(CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END) AS DOUBLE) AS versions FROM events GROUP BY 1",
)


# -- current elements with all their versions beside them


def accounts(spark: SparkSession, sf_dir: str) -> Graph:
    """``Account``: a user's last event, the earlier ones being its versions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value", "ts")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value", "ts"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")
    return test_graph(spark, sf_dir).add_nodes("Account", last, "user_id", "ts", versions=events, seq="event_id")


def _account(name: str, text: str, sql: str, **options) -> None:
    _query(name, sql)(lambda spark, sf_dir: compile_query(accounts(spark, sf_dir), text, **options))


_account(
    "true_for_versions",
    "MATCH (a:Account) WHERE tide.trueFor(a.event_type <> 'error', duration({hours: 30})) RETURN a.user_id AS user, a.event_type AS kind",
    """WITH broken AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS at FROM events GROUP BY 1),
    since AS (SELECT e.user_id, min(ts) AS start, arg_max(event_type, ts) AS kind FROM events e JOIN broken b ON b.user_id = e.user_id AND (b.at IS NULL OR e.ts > b.at) GROUP BY 1)
    SELECT user_id AS user, kind FROM since WHERE date_trunc('millisecond', start) + INTERVAL 30 HOUR <= TIMESTAMP '2024-01-31'""",
    now=dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc),
)
_account(
    "earlier_values_now",
    "MATCH (a:Account) RETURN a.user_id AS user, a.value AS now, tide.previousValue(a.value, 0.0) AS before, tide.previousDistinctValue(a.event_type, 'none') AS kind",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM events)
    SELECT user_id AS user, max(value) FILTER (n = 1) AS now, coalesce(max(value) FILTER (n = 2), 0.0) AS before, coalesce(arg_max(event_type, ts) FILTER (event_type <> latest), 'none') AS kind FROM o GROUP BY 1""",
)
_account(
    "version_beside_current",
    "MATCH (a:Account) WITH a, tide.getVersionByTimestamp(a, datetime('2024-01-10T00:00:00Z')) AS v WHERE v.value < a.value RETURN a.user_id AS user, a.value AS now, v.value AS old",
    """WITH v AS (SELECT user_id, arg_max(value, ts) AS old FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00.001' GROUP BY 1), n AS (SELECT user_id, arg_max(value, ts) AS now FROM events GROUP BY 1)
    SELECT user_id AS user, now, old FROM n JOIN v USING (user_id) WHERE old < now""",
)
