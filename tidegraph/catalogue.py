"""Queries registered for the engine itself, with their SQL.

The test tables as a property graph: a label per table, relations as equalities of
their keys; ``User`` nodes are users whose successive events are their versions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.operators import ParseJson, Pipeline, Promote, Relabel
from tidegraph.plans.compile import compile_query
from tidegraph.sources import MappingRule, map_records
from tidegraph.sources.readers import as_changes
from tidegraph.streaming import current_elements, diff_results, element_tables
from tidegraph.streaming.changelog import advance_elements

#: The clock of queries that depend on time.
CLOCK = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)
#: label, table, key, column of the last change
_NODES = (
    ("Region", "region", "r_regionkey", None),
    ("Nation", "nation", "n_nationkey", None),
    ("Customer", "customer", "c_custkey", None),
    ("Supplier", "supplier", "s_suppkey", None),
    ("Part", "part", "p_partkey", None),
    ("Order", "orders", "o_orderkey", "o_orderdate"),
    ("LineItem", "lineitem", "l_orderkey", "l_shipdate"),
    ("Event", "events", "event_id", "ts"),
    ("Document", "documents", "doc_id", None),
    ("Label", "labels", "doc_id", None),
    ("Page", "pages", "page_id", None),
)


def test_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")  # noqa: E731  opened when first used
    g = Graph()
    for label, table, key, changed in _NODES:
        g.add_nodes(label, read(table), key, changed)
    g.add_nodes("User", lambda: read("events")().select("user_id", "event_type", "value", "ts"), "user_id", "ts", history=True)
    g.add_join("IN_REGION", ("Nation", "n_regionkey"), ("Region", "r_regionkey"))
    g.add_join("IN_NATION", ("Customer", "c_nationkey"), ("Nation", "n_nationkey"), ("Supplier", "s_nationkey"))
    g.add_join("PLACED_BY", ("Order", "o_custkey"), ("Customer", "c_custkey"))
    g.add_join("OF_ORDER", ("LineItem", "l_orderkey"), ("Order", "o_orderkey"))
    g.add_join("OF_PART", ("LineItem", "l_partkey"), ("Part", "p_partkey"))
    g.add_join("SIZED_LIKE", ("Part", "p_partkey"), ("Part", "p_size"))
    g.add_join("LABELS", ("Label", "doc_id"), ("Document", "doc_id"))
    # orders as relations from customers to themselves' nation, with properties of their own
    g.add_relations("ORDERED", read("orders"), ("Customer", "o_custkey"), ("Customer", "o_custkey"), "o_orderkey", "o_orderdate")
    g.add_relations("SHIPPED", read("lineitem"), ("Supplier", "l_suppkey"), ("Part", "l_partkey"), None, "l_shipdate")
    return g


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, text: str, sql: str | None, language: str = "cypher", **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_query(test_graph(spark, sf_dir), text, language, **options)

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


_add(
    "segment_orders",
    "MATCH (o:Order)-[:PLACED_BY]-(c:Customer) WHERE o.o_totalprice > 1000 RETURN c.c_mktsegment AS seg, count(o) AS n, round(avg(o.o_totalprice), 3) AS avg_price",
    "SELECT c_mktsegment AS seg, count(*) AS n, round(avg(o_totalprice), 3) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1",
)
_add(
    "inline_predicates",
    "MATCH (n:Nation)-[:IN_REGION]-(r:Region {r_name: 'ASIA'}), (c:Customer WHERE c.c_acctbal > 5000.0)-[:IN_NATION]->(n) RETURN n.n_name AS nation, c.c_name AS customer",
    "SELECT n_name AS nation, c_name AS customer FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA' AND c_acctbal > 5000.0",
)
_add(
    "five_hops",
    "MATCH (l:LineItem)-[:OF_ORDER]-(o:Order)-[:PLACED_BY]-(c:Customer)-[:IN_NATION]-(n:Nation)-[:IN_REGION]-(r:Region) WHERE l.l_returnflag = 'R' RETURN r.r_name AS region, n.n_name AS nation, count(l) AS lines, sum(l.l_quantity) AS quantity",
    "SELECT r_name AS region, n_name AS nation, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
)
_add(
    "star_shared_alias",
    "MATCH (c:Customer)-[:IN_NATION]-(n:Nation), (s:Supplier)-[:IN_NATION]-(n) RETURN n.n_name AS nation, count(c) AS pairs",
    "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
_add(
    "label_alternation",
    "MATCH (x:Customer|Supplier)-[:IN_NATION]-(n:Nation) RETURN n.n_name AS nation, count(x) AS n, count(x.c_name) AS customers, count(x.s_name) AS suppliers",
    "SELECT n_name AS nation, count(*) AS n, count(c) AS customers, count(s) AS suppliers FROM (SELECT c_nationkey AS k, c_name AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_name FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1",
)
_add(
    "relation_properties",
    "MATCH (s:Supplier)-[r:SHIPPED]->(p:Part) WHERE r.l_quantity > 45.0 RETURN s.s_name AS supplier, count(p) AS parts, max(r.l_quantity) AS most",
    "SELECT s_name AS supplier, count(*) AS parts, max(l_quantity) AS most FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45.0 GROUP BY 1",
)
_add(
    "relation_left",
    "MATCH (p:Part {p_size: 7})<-[r:SHIPPED WHERE r.l_discount > 0.05]-(s:Supplier) RETURN p.p_name AS part, s.s_suppkey AS supplier",
    "SELECT p_name AS part, s_suppkey AS supplier FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7 AND l_discount > 0.05",
)
_add(
    "relation_either",
    "MATCH (c:Customer)-[r:ORDERED]-(d:Customer) RETURN c.c_mktsegment AS seg, count(r) AS n",
    "SELECT c_mktsegment AS seg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
_add(
    "optional_count",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED_BY]-(o:Order WHERE o.o_totalprice > 300000) RETURN c.c_custkey AS custkey, count(o) AS n, max(o.o_totalprice) AS most",
    "SELECT c_custkey AS custkey, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1",
)
_add(
    "optional_path",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED_BY]-(o:Order)-[:OF_ORDER]-(l:LineItem WHERE l.l_quantity > 49.0) RETURN c.c_custkey AS custkey, count(l) AS n, coalesce(min(l.l_extendedprice), 0.0) AS least",
    "SELECT c_custkey AS custkey, count(q) AS n, coalesce(min(p), 0.0) AS least FROM customer LEFT JOIN (SELECT o_custkey AS k, l_quantity AS q, l_extendedprice AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49.0) ON k = c_custkey GROUP BY 1",
)
_add(
    "optional_two",
    "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_NATION]-(s:Supplier WHERE s.s_acctbal > 9000.0) OPTIONAL MATCH (n)-[:IN_REGION]-(r:Region {r_name: 'EUROPE'}) RETURN n.n_name AS nation, s.s_name AS supplier, r.r_name AS region",
    "SELECT n_name AS nation, s_name AS supplier, r_name AS region FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000.0 LEFT JOIN region ON n_regionkey = r_regionkey AND r_name = 'EUROPE'",
)
_add(
    "reaggregation",
    "MATCH (o:Order)-[:PLACED_BY]-(c:Customer) WITH c.c_nationkey AS nation, c.c_custkey AS cust, count(o) AS n WHERE n > 2 WITH nation, avg(n) AS mean, count(cust) AS customers RETURN nation, round(mean, 4) AS mean, customers",
    "WITH a AS (SELECT c_nationkey AS nation, c_custkey AS cust, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT CAST(nation AS BIGINT) AS nation, round(avg(n), 4) AS mean, count(*) AS customers FROM a WHERE n > 2 GROUP BY 1",
)
_add(
    "group_by_element",
    "MATCH (o:Order)-[:PLACED_BY]-(c:Customer) WITH c, count(o) AS n, max(o.o_totalprice) AS most WHERE most > 400000.0 RETURN c.c_name AS name, c.c_mktsegment AS seg, n, most",
    "SELECT c_name AS name, c_mktsegment AS seg, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, 1, 2 HAVING max(o_totalprice) > 400000.0",
)
_add(
    "aggregate_in_scalar",
    "MATCH (p:Part)-[:OF_PART]-(l:LineItem) RETURN p.p_partkey AS part, count(l) * 10 + 1 AS scaled, max(l.l_quantity) - min(l.l_quantity) AS spread",
    "SELECT p_partkey AS part, count(*) * 10 + 1 AS scaled, max(l_quantity) - min(l_quantity) AS spread FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
)
_add(
    "aggregate_in_where",
    "MATCH (o:Order) WHERE o.o_totalprice > avg(o.o_totalprice) * 1.5 RETURN o.o_orderkey AS orderkey",
    "SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5",
)
_add(
    "and_or_one_level",
    "MATCH (l:LineItem) WHERE l.l_returnflag = 'A' OR l.l_linestatus = 'F' AND l.l_quantity > 40.0 RETURN count(l) AS n",
    "SELECT count(*) AS n FROM lineitem WHERE (l_returnflag = 'A' OR l_linestatus = 'F') AND l_quantity > 40.0",
)
_add(
    "null_logic",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED_BY]-(o:Order WHERE o.o_totalprice > 350000) WITH c.c_custkey AS k, o.o_totalprice AS p RETURN k, NOT (p > 0.0) AS none, p = null AS same, p <> null AS differs, p IS NULL AS empty, k = 1.0 AS typed",
    "SELECT c_custkey AS k, NOT coalesce(o_totalprice > 0, false) AS none, o_totalprice IS NULL AS same, false AS differs, o_totalprice IS NULL AS empty, false AS typed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000",
)
_add(
    "text_functions",
    "MATCH (p:Part) WHERE p.p_name CONTAINS 'o' AND p.p_brand STARTS WITH 'Brand' AND NOT p.p_name ENDS WITH 't' RETURN p.p_partkey AS k, toUpper(p.p_name) AS up, toLower(p.p_brand) AS low, left(p.p_name, 3) AS l, right(p.p_name, 2) AS r, replace(p.p_name, 'a', 'bb') AS rep, substring(p.p_name, 1, 2) AS sub, size(split(p.p_name, ' ')) AS words, reverse(p.p_brand) AS back, char_length(p.p_name) AS n, trim('  x ') AS t",
    "SELECT p_partkey AS k, upper(p_name) AS up, lower(p_brand) AS low, left(p_name, 3) AS l, right(p_name, 2) AS r, replace(p_name, 'a', 'bb') AS rep, substr(p_name, 2, 2) AS sub, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words, reverse(p_brand) AS back, CAST(strlen(p_name) AS BIGINT) AS n, 'x' AS t FROM part WHERE contains(p_name, 'o') AND starts_with(p_brand, 'Brand') AND NOT ends_with(p_name, 't')",
)
_add(
    "numeric_functions",
    "MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS up, floor(c.c_acctbal) AS down, round(0.0 - 2.5) AS r, sign(c.c_acctbal) AS s, c.c_custkey % 7 AS m, c.c_custkey ^ 2 AS sq, c.c_custkey / 2 AS half, toInteger(c.c_acctbal) AS i, toFloat('2.5') AS f, round(c.c_acctbal, 1, 'FLOOR') AS fl",
    "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, -2.0::DOUBLE AS r, CAST(sign(c_acctbal) AS BIGINT) AS s, c_custkey % 7 AS m, c_custkey * c_custkey AS sq, c_custkey / 2.0::DOUBLE AS half, CAST(floor(c_acctbal) AS BIGINT) AS i, 2.5::DOUBLE AS f, floor(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE AS fl FROM customer",
)
_add(
    "list_functions",
    "MATCH (n:Nation) WITH n.n_nationkey AS k, range(0, n.n_nationkey) AS l RETURN k, size(l) AS n, head(l) AS h, last(l) AS la, size(tail(l)) AS t, [x IN l WHERE x % 2 = 0 | x * x] AS squares, reduce(a = 0, x IN l | a + x) AS total, 3 IN l AS has, l[0..2] AS two, l[-1] AS final, coll.indexOf(l, 4) AS at, listMax(l) AS most",
    "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey + 1 AS BIGINT) AS n, 0::BIGINT AS h, CAST(n_nationkey AS BIGINT) AS la, CASE WHEN n_nationkey >= 0 THEN CAST(n_nationkey AS BIGINT) END AS t, [x * x FOR x IN range(0, n_nationkey + 1) IF x % 2 = 0] AS squares, CAST(n_nationkey * (n_nationkey + 1) // 2 AS BIGINT) AS total, n_nationkey >= 3 AS has, range(0, least(2, n_nationkey + 1)) AS two, CAST(n_nationkey AS BIGINT) AS final, CASE WHEN n_nationkey >= 4 THEN 4 ELSE -1 END::BIGINT AS at, CAST(n_nationkey AS BIGINT) AS most FROM nation",
)
_add(
    "case_forms",
    "MATCH (o:Order) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS status, CASE WHEN o.o_totalprice > 300000.0 THEN 'high' WHEN o.o_totalprice > 100000.0 THEN 'middle' END AS band",
    "SELECT o_orderkey AS k, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS status, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' END AS band FROM orders",
)
_add(
    "date_fields",
    "MATCH (o:Order) WITH o.o_orderkey AS k, date(o.o_orderdate) AS d, o.o_orderdate AS t RETURN k, d.year AS y, d.month AS m, d.day AS dd, d.quarter AS q, d.week AS w, d.dayOfWeek AS dow, d.ordinalDay AS doy, t.hour AS h, date.truncate('month', d) AS first, d + duration({days: 40}) AS later, duration.inDays(date('1995-01-01'), d).days AS days",
    "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, isodow(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, hour(o_orderdate) AS h, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(CAST(o_orderdate AS DATE) + INTERVAL 40 DAY AS DATE) AS later, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders",
)
_add(
    "divide_by_zero_skips",
    "MATCH (n:Nation) RETURN n.n_nationkey AS k, 100 / n.n_nationkey AS share",
    "SELECT CAST(n_nationkey AS BIGINT) AS k, 100.0::DOUBLE / n_nationkey AS share FROM nation WHERE n_nationkey <> 0",
)
_add(
    "collected",
    "MATCH (n:Nation)-[:IN_REGION]-(r:Region) RETURN r.r_name AS region, size(collect(n.n_name)) AS n, 'NATION_1' IN collect(n.n_name) AS has",
    "SELECT r_name AS region, count(*) AS n, coalesce(list_contains(list(n_name), 'NATION_1'), false) AS has FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
_add(
    "slope",
    "MATCH (l:LineItem) RETURN l.l_returnflag AS flag, round(linear.linearGradient(l.l_quantity, l.l_extendedprice), 4) AS slope",
    "SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1",
)
_add(
    "labelled_documents",
    "MATCH (d:Document)-[:LABELS]-(x:Label {quality: 1}) RETURN d.lang AS lang, count(d) AS n, sum(x.toxic) AS toxic, max(d.n_chars) AS longest",
    "SELECT lang, count(*) AS n, CAST(sum(toxic) AS DOUBLE) AS toxic, CAST(max(n_chars) AS DOUBLE) AS longest FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1",
)

_SPEAK = "MATCH (u:User)"
_add(
    "previous_value",
    f"{_SPEAK} RETURN u.user_id AS user, u.ts AS ts, tide.previousValue(u.value, 0.0) AS before, u.value AS now",
    "SELECT user_id AS user, ts, coalesce(lag(value) OVER w, CASE WHEN row_number() OVER w = 1 THEN 0.0 END) AS before, value AS now FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
)
_add(
    "previous_distinct_value",
    f"{_SPEAK} RETURN u.user_id AS user, u.ts AS ts, tide.previousDistinctValue(u.event_type) AS before",
    "WITH a AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT user_id AS user, ts, last_value(CASE WHEN p IS DISTINCT FROM event_type THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS before FROM a",
)
_add(
    "version_by_timestamp",
    "MATCH (u:User) WITH u, tide.getVersionByTimestamp(u, datetime('2024-01-10T00:00:00Z')) AS v WHERE v.value > 0.0 RETURN u.user_id AS user, v.event_type AS kind, count(u) AS n",
    "WITH v AS (SELECT user_id, arg_max(event_type, ts) AS kind, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1) SELECT e.user_id AS user, kind, count(*) AS n FROM events e JOIN v ON v.user_id = e.user_id WHERE v.value > 0.0 GROUP BY 1, 2",
)
_add(
    "versions_by_range",
    "MATCH (u:User) WITH u, tide.getVersionsByTimeRange(u, datetime('2024-01-10T00:00:00Z'), datetime('2024-01-12T00:00:00Z')) AS vs RETURN u.user_id AS user, max(size(vs)) AS versions",
    "SELECT user_id AS user, CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12') AS DOUBLE) AS versions FROM events GROUP BY 1",
)
_add(
    "true_for",
    "MATCH (e:Event) WHERE tide.trueFor(e.event_type = 'error', duration({days: 5})) RETURN e.event_id AS id",
    "SELECT event_id AS id FROM events WHERE event_type = 'error' AND ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-16'",
    now=CLOCK,
)
_add(
    "true_later",
    "MATCH (e:Event) WHERE tide.trueLater(e.value > 50.0, e.ts + duration({hours: 36})) RETURN e.event_id AS id",
    "SELECT event_id AS id FROM events WHERE value > 50.0 AND ts + INTERVAL 36 HOUR <= TIMESTAMP '2024-01-16'",
    now=CLOCK,
)
_add(
    "true_until",
    "MATCH (e:Event) WHERE tide.trueUntil(e.event_type = 'click', e.ts + duration({days: 2})) OR tide.trueNowOrLater(e.value < 1.0, e.ts + duration({days: 1})) RETURN e.event_id AS id",
    "SELECT event_id AS id FROM events WHERE (event_type = 'click' AND ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-16') OR value < 1.0",
    now=CLOCK,
)
_add(
    "sliding_window",
    "MATCH (e:Event) WHERE e.ts <= datetime('2024-01-16T00:00:00Z') RETURN e.event_type AS kind, tide.slidingWindow(duration({days: 3}), max(e.value)) AS most, tide.slidingWindow(duration({days: 3}), count(e)) AS n",
    "SELECT event_type AS kind, max(value) FILTER (TIMESTAMP '2024-01-16' < ts + INTERVAL 3 DAY) AS most, count(*) FILTER (TIMESTAMP '2024-01-16' < ts + INTERVAL 3 DAY) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-16' GROUP BY 1",
    now=CLOCK,
)
_add(
    "gql_pipeline",
    "MATCH (o:Order)-[:PLACED_BY]-(c:Customer) LET band = CAST(o.o_totalprice / 100000 AS INTEGER) FILTER band >= 1 RETURN c.c_mktsegment AS seg, band, count(o) AS n GROUP BY seg, band NEXT FILTER n > 1 RETURN seg, max(n) AS most GROUP BY seg",
    "WITH a AS (SELECT c_mktsegment AS seg, CAST(floor(o_totalprice / 100000) AS BIGINT) AS band, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE floor(o_totalprice / 100000) >= 1 GROUP BY 1, 2) SELECT seg, CAST(max(n) AS DOUBLE) AS most FROM a WHERE n > 1 GROUP BY 1",
    "gql",
)
_add(
    "gql_yield",
    "MATCH (n:Nation)-[:IN_REGION]-(r:Region) YIELD n.n_name AS nation, r.r_name AS region RETURN upper(region) AS region, count(nation) AS nations GROUP BY region",
    "SELECT upper(r_name) AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "gql",
)
_add(
    "gql_total",
    "MATCH (l:LineItem) RETURN count(l) AS n, max(l.l_quantity) AS most GROUP BY ()",
    "SELECT count(*) AS n, max(l_quantity) AS most FROM lineitem",
    "gql",
)



# -- change logs, differences and middleware over the events table


def _query(name: str, sql: str):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        SQL[name] = sql
        return run

    return add


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users: purchases are inserts, errors delete, the rest are updates."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "insert").otherwise("update")
    # updates by clicks name one property only, so that the other is kept from before
    props = F.when(F.col("event_type") == "click", F.to_json(F.struct("value"))).otherwise(F.to_json(F.struct("value", "event_type", "props")))
    return as_changes(
        events, seq=F.col("event_id"), op=op, element_type=F.lit("node"), source_id=F.lit("events"), element_id=F.col("user_id").cast("string"), labels=F.array(F.lit("User")), effective_from=F.unix_millis(F.col("ts").cast("timestamp")), properties=props
    )


_LIVE = """
    WITH e AS (SELECT *, max(CASE WHEN event_type IN ('error', 'purchase') THEN event_id END) OVER (PARTITION BY user_id) AS since FROM events),
    live AS (SELECT * FROM e WHERE (since IS NULL OR event_id >= since) AND event_type <> 'error')
    SELECT user_id AS user, arg_max(value, event_id) AS value, arg_max(event_type, event_id) FILTER (event_type <> 'click') AS kind FROM live GROUP BY 1
"""


@_query("current_state", _LIVE)
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = element_tables(current_elements(event_changes(spark, sf_dir)), {"User": {"value": "double", "event_type": "string"}})
    return compile_query(graph, "MATCH (u:User) RETURN toInteger(elementId(u)) AS user, u.value AS value, u.event_type AS kind")


@_query("advanced_state", _LIVE)
def advanced_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state reached in two steps."""
    changes = event_changes(spark, sf_dir)
    middle = changes.agg(F.percentile_approx("seq", 0.5)).head()[0]
    state = advance_elements(current_elements(changes.where(F.col("seq") <= middle)), changes.where(F.col("seq") > middle))
    graph = element_tables(state, {"User": {"value": "double", "event_type": "string"}})
    return compile_query(graph, "MATCH (u:User) RETURN toInteger(elementId(u)) AS user, u.value AS value, u.event_type AS kind")


@_query(
    "result_differences",
    """
    WITH a AS (SELECT event_type AS kind, count(*) AS n FROM events WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-02' GROUP BY 1),
    b AS (SELECT event_type AS kind, count(*) AS n FROM events WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-16' GROUP BY 1)
    SELECT 'aggregation' AS op, coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, a.kind IS NULL AS new
    FROM a FULL JOIN b ON a.kind = b.kind WHERE a.n IS DISTINCT FROM b.n
    """,
)
def result_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "MATCH (e:Event) WHERE tide.trueLater(true, e.ts + duration({hours: 1})) RETURN e.event_type AS kind, count(e) AS n"
    at = lambda day: compile_query(test_graph(spark, sf_dir), text, now=dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc))
    diff = diff_results(at(2), at(16), ["kind"], {"n": 0})
    return diff.select("op", F.col("after.kind").alias("kind"), F.col("before.n").alias("before"), F.col("after.n").alias("after"), F.col("default_before").alias("new"))


@_query(
    "middleware_chain",
    "SELECT event_id AS seq, 'Person' AS label, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events WHERE event_type NOT IN ('error', 'click')",
)
def middleware_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text property parsed, a nested value promoted, the label renamed."""
    chain = Pipeline((ParseJson("props", "parsed", on_error="skip"), Promote((("$.parsed.k", "k"),), on_error="skip"), Relabel({"User": "Person"})))
    rows = chain.apply(event_changes(spark, sf_dir)).where(F.get_json_object("properties", "$.event_type").isNotNull() & (F.col("op") != "delete"))
    at = lambda path, kind: F.get_json_object("properties", path).cast(kind)
    return rows.select("seq", F.col("labels")[0].alias("label"), at("$.k", "long").alias("k"), at("$.value", "double").alias("value"))


@_query(
    "mapped_records",
    "SELECT 'k' || json_extract_string(props, '$.k') AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^[1-3]')",
)
def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("props").alias("value"))
    rule = MappingRule("k{$.k}", ("K",), {"k": "$.k"}, when=("$.k", "regex", "^[1-3]"))
    return map_records(records, [rule]).select(F.col("element_id").alias("id"), F.get_json_object("properties", "$.k").cast("long").alias("k"))
