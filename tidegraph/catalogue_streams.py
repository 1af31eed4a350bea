"""Further registered queries: differences, middleware, sources, sinks and streams, with their SQL."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.catalogue import _LIVE, _query, event_changes
from tidegraph.operators import Decoder, Pipeline, Unwind
from tidegraph.operators.middleware import Map, Mapping
from tidegraph.plans.compile import compile_query
from tidegraph.sources import PushSource, file_sink, jdbc_sink, jdbc_table, json_folder, memory_sink, mock_changes, script_file, snapshot_changes, table_snapshot
from tidegraph.sources.embedded import shut
from tidegraph.sources.readers import as_changes
from tidegraph.sources.sinks import rendered
from tidegraph.streaming import ContinuousQuery, current_elements, element_tables, element_versions

_USERS = {"User": {"value": "double", "event_type": "string"}}


def folder(spark: SparkSession, what: str) -> str:
    """A fresh folder that all executors see; without a shared one only where Spark runs in this process alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The change log of the events up to the middle, and the whole of it."""
    log = event_changes(spark, sf_dir)
    return log.where(F.col("seq") <= 4999), log


_STATES = """
    WITH e AS (SELECT *, max(CASE WHEN event_type IN ('error', 'purchase') THEN event_id END) OVER (PARTITION BY user_id) AS since, max(CASE WHEN event_type IN ('error', 'purchase') AND event_id <= 4999 THEN event_id END) OVER (PARTITION BY user_id) AS since0 FROM events),
    a AS (SELECT user_id, arg_max(value, event_id) AS v FROM e WHERE event_id <= 4999 AND (since0 IS NULL OR event_id >= since0) AND event_type <> 'error' GROUP BY 1),
    b AS (SELECT user_id, arg_max(value, event_id) AS v FROM e WHERE (since IS NULL OR event_id >= since) AND event_type <> 'error' GROUP BY 1)
"""
_ROWS = "MATCH (u:User) WHERE u.value > 2.0 RETURN toInteger(elementId(u)) AS user, u.value AS value"


def _row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ContinuousQuery(_ROWS, _USERS)
    before, after = (q.rows(log) for log in _halves(spark, sf_dir))
    return q.diff(before, after)


_ROW_SQL = f"""{_STATES}, p AS (SELECT * FROM a WHERE v > 2.0), q AS (SELECT * FROM b WHERE v > 2.0)
    SELECT CASE WHEN p.user_id IS NULL THEN 'add' WHEN q.user_id IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(p.user_id, q.user_id) AS user, p.v AS before, q.v AS after
    FROM p FULL JOIN q ON p.user_id = q.user_id WHERE p.v IS DISTINCT FROM q.v"""


@_query("row_differences", _ROW_SQL)
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, updates (a row is known by its elements) and deletes between two states."""
    diff = _row_diff(spark, sf_dir)
    return diff.select("op", F.coalesce("after.user", "before.user").alias("user"), F.col("before.value").alias("before"), F.col("after.value").alias("after"))


@_query(
    "group_switches",
    """WITH t AS (SELECT event_id, event_type AS kind, value FROM events WHERE event_id % 5 <> 0), a AS (SELECT kind, count(*) AS n, sum(value) AS s FROM t GROUP BY 1),
    u AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'moved' ELSE kind END AS kind, value FROM t WHERE kind <> 'view' OR event_id % 3 = 0), b AS (SELECT kind, count(*) AS n, sum(value) AS s FROM u GROUP BY 1)
    SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) * 2 AS before, coalesce(b.n, 0) * 2 AS after, a.kind IS NULL AS new, b.kind IS NULL AS gone, round(coalesce(b.s, 0), 4) AS total FROM a FULL JOIN b ON a.kind = b.kind WHERE a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s""",
)
def group_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that move from group to group; a group that empties or appears has the values of no rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 5 <> 0")
    moved = events.where("event_type <> 'view' OR event_id % 3 = 0").withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "moved").otherwise(F.col("event_type")))
    q = ContinuousQuery("MATCH (e:Event) RETURN e.event_type AS kind, count(e) * 2 AS twice, round(sum(e.value), 4) AS total", {"Event": {"event_type": "string", "value": "double"}})
    at = lambda df: q.rows(table_snapshot(df, "Event", "event_id"))
    diff = q.diff(at(events), at(moved))
    return diff.select(F.coalesce("after.kind", "before.kind").alias("kind"), F.col("before.twice").alias("before"), F.col("after.twice").alias("after"), F.col("default_before").alias("new"), F.col("default_after").alias("gone"), F.col("after.total").alias("total"))


@_query("all_versions", "SELECT user_id AS user, event_id AS seq, value, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id), -1) < event_id AND coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id), -1) <= event_id AS live FROM events QUALIFY event_type <> 'error'")
def all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = element_versions(event_changes(spark, sf_dir), ["value"])
    return versions.select(F.col("element_id").cast("long").alias("user"), "seq", F.col("properties")["value"].cast("double").alias("value"), "live")


@_query("retained_history", f"SELECT (SELECT round(sum(value), 4) FROM events WHERE event_type <> 'error') AS every, round(sum(value), 4) AS now, count(*) AS n FROM ({_LIVE})")
def retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ContinuousQuery("MATCH (u:User) RETURN round(sum(x.retainHistory(u.value)), 4) AS every, round(sum(u.value), 4) AS now, count(u) AS n", _USERS)
    return q.result(event_changes(spark, sf_dir))


@_query("equal_identifiers", "SELECT event_type AS source, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def equal_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of one identifier that come from several sources, joined to nodes of their own source only."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    common = {"op": F.lit("insert"), "effective_from": F.lit(0), "source_id": F.col("event_type"), "seq": F.col("event_id")}
    users = as_changes(events, element_type=F.lit("node"), element_id=F.concat(F.lit("u"), F.col("user_id")), labels=F.array(F.lit("User")), properties=F.lit("{}"), **common)
    homes = as_changes(events, element_type=F.lit("node"), element_id=F.lit("home"), labels=F.array(F.lit("Home")), properties=F.to_json(F.struct(F.col("event_type").alias("name"))), **common)
    ends = {"src_id": F.concat(F.lit("u"), F.col("user_id")), "dst_id": F.lit("home")}
    lives = as_changes(events, element_type=F.lit("relation"), element_id=F.concat(F.lit("r"), F.col("user_id")), labels=F.array(F.lit("LIVES")), properties=F.lit("{}"), **common, **ends)
    graph = element_tables(current_elements(users.unionByName(homes).unionByName(lives)), {"User": {}, "Home": {"name": "string"}}, {"LIVES": ("User", "Home", {})})
    return compile_query(graph, "MATCH (u:User)-[:LIVES]->(h:Home) RETURN h.name AS source, count(u) AS users")


# -- middleware


def _as_nodes(df: DataFrame, label: str, key: str, **props) -> DataFrame:
    return as_changes(df, seq=F.col(key), op=F.lit("insert"), element_type=F.lit("node"), source_id=F.lit("t"), element_id=F.col(key).cast("string"), labels=F.array(F.lit(label)), effective_from=F.lit(0), properties=F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])))


@_query("decoded_properties", "SELECT event_id AS seq, event_type AS b64, event_type AS url64, event_type AS hex, 'a ' || event_type || '/' AS url, event_type || chr(10) AS escaped, 'not base64!' AS kept FROM events")
def decoded_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    props = {
        "b64": F.base64(kind.cast("binary")), "url64": F.translate(F.rtrim(F.base64(kind.cast("binary")), F.lit("=")), "+/", "-_"), "hex": F.lower(F.hex(kind.cast("binary"))),
        "url": F.concat(F.lit("a%20"), kind, F.lit("%2F")), "escaped": F.concat(kind, F.lit("\\n")), "kept": F.lit("not base64!"),
    }
    changes = _as_nodes(spark.read.parquet(f"{sf_dir}/events.parquet"), "E", "event_id", **props)
    chain = Pipeline((Decoder("base64", "b64"), Decoder("base64url", "url64"), Decoder("hex", "hex"), Decoder("url", "url"), Decoder("json_escape", "escaped"), Decoder("base64", "kept", on_error="skip")))
    return chain.apply(changes).select("seq", *[F.get_json_object("properties", f"$.{k}").alias(k) for k in props])


@_query("unwound_items", "SELECT c_custkey AS parent, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def unwound_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an array property become nodes related to their parent."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))).alias("items"))
    changes = _as_nodes(read("customer").join(items, "c_custkey"), "Customer", "c_custkey", items=F.col("items"))
    rows = Unwind("Customer", "$.items[*]", "Item", "$.id", "HAS").apply(changes)
    graph = element_tables(current_elements(rows), {"Customer": {}, "Item": {"price": "double"}}, {"HAS": ("Customer", "Item", {})})
    return compile_query(graph, "MATCH (c:Customer)-[:HAS]->(i:Item) RETURN toInteger(elementId(c)) AS parent, count(i) AS n, sum(i.price) AS total")


@_query("mapped_changes", "SELECT 's' || CAST(event_id AS VARCHAR) AS id, 'update' AS op, 'Reading' AS label, value FROM events WHERE event_type = 'click'")
def mapped_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New changes from selected parts of old ones; changes without a mapping are dropped."""
    readings = F.array(F.struct(F.lit("speed").alias("name"), F.col("value").alias("v")), F.struct(F.lit("other").alias("name"), F.lit(0.0).alias("v")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = _as_nodes(events.where("event_type = 'click'"), "Signal", "event_id", id=F.concat(F.lit("s"), F.col("event_id")), signals=readings)
    rest = _as_nodes(events.where("event_type = 'view'"), "Noise", "event_id", id=F.col("event_id"))
    rule = Mapping(selector="$.signals[?(@.name == 'speed')]", label="Reading", id="$.id", op="update", properties={"value": "$selected.v"})
    out = Map({("Signal", "insert"): (rule,)}).apply(clicks.unionByName(rest))
    return out.select(F.col("element_id").alias("id"), "op", F.col("labels")[0].alias("label"), F.get_json_object("properties", "$.value").cast("double").alias("value"))


# -- sources


@_query("script_source", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def script_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap script of nations and regions, written and read back."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()  # noqa: E731  25 and 5 rows
    lines = [{"kind": "Header", "start_time": "2024-01-01T00:00:00Z", "description": ""}]
    lines += [{"kind": "Node", "id": f"r{r.r_regionkey}", "labels": ["Region"], "properties": {"name": r.r_name}} for r in read("region")]
    for n in read("nation"):
        lines += [{"kind": "Node", "id": f"n{n.n_nationkey}", "labels": ["Nation"], "properties": {}}, {"kind": "Relation", "id": f"e{n.n_nationkey}", "labels": ["LIES_IN"], "start_id": f"n{n.n_nationkey}", "end_id": f"r{n.n_regionkey}", "properties": {}}]
    lines.append({"kind": "Finish", "description": ""})
    path = folder(spark, "script")
    spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(lines)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    q = ContinuousQuery("MATCH (n:Nation)-[:LIES_IN]->(r:Region) RETURN r.name AS region, count(n) AS n", {"Nation": {}, "Region": {"name": "string"}}, {"LIES_IN": ("Nation", "Region", {})})
    return q.result(script_file(spark, path))


@_query("snapshot_source", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 11 = 0 THEN 'insert' ELSE 'update' END AS op, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 OR o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 OR o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0 GROUP BY 1")
def snapshot_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two states of a table, as changes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    after = orders.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return snapshot_changes(orders.where("o_orderkey % 11 <> 0"), after, "Order", "o_orderkey").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@_query("generated_source", "SELECT 'sensor_' || CAST(i AS VARCHAR) AS id, CAST(20 AS BIGINT) AS changes FROM range(5) t(i)")
def generated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mock_changes(spark, 100, "sensor", 5).groupBy(F.col("element_id").alias("id")).agg(F.count(F.lit(1)).alias("changes"))


@_query("table_source", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows as elements."""
    q = ContinuousQuery("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(c) AS n, round(sum(c.c_acctbal), 2) AS total", {"Customer": {"c_mktsegment": "string", "c_acctbal": "double"}})
    return q.result(table_snapshot(spark.read.parquet(f"{sf_dir}/customer.parquet"), "Customer", "c_custkey"))


@_query("streamed_state", "SELECT kind, count(*) AS n, round(sum(value), 4) AS total FROM (" + _LIVE + ") WHERE kind IS NOT NULL GROUP BY 1")
def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live result after a stream of two batches."""
    place, log = folder(spark, "stream"), event_changes(spark, sf_dir)
    q = ContinuousQuery("MATCH (u:User) WHERE u.event_type IS NOT NULL RETURN u.event_type AS kind, count(u) AS n, round(sum(u.value), 4) AS total", _USERS)
    for part in (F.col("seq") <= 4999, F.col("seq") > 4999):
        log.where(part).coalesce(2).write.mode("append").option("ignoreNullFields", "false").json(f"{place}/in")
        q.start(json_folder(spark, f"{place}/in"), f"{place}/state", lambda diff, number: None).awaitTermination()
    return q.results(spark, f"{place}/state")


@_query("pushed_state", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) + 100 AS k FROM nation WHERE n_nationkey % 4 <> 0")
def pushed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes pushed by this process: inserts, then updates and deletes."""
    place = folder(spark, "push")
    source, q = PushSource(spark, f"{place}/in"), ContinuousQuery("MATCH (n:Nation) RETURN n.name AS name, n.k AS k", {"Nation": {"name": "string", "k": "bigint"}})
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # 25 rows
    source.send([{"op": "insert", "element_id": str(n.n_nationkey), "labels": ["Nation"], "properties": {"name": n.n_name, "k": n.n_nationkey}} for n in nations])
    q.start(source.stream(), f"{place}/state", memory_sink([])).awaitTermination()
    source.send([{"op": "update" if n.n_nationkey % 4 else "delete", "element_id": str(n.n_nationkey), "labels": ["Nation"], "properties": {"k": n.n_nationkey + 100}} for n in nations])
    q.start(source.stream(), f"{place}/state", memory_sink([])).awaitTermination()
    return q.results(spark, f"{place}/state")


# -- sinks, read back


@_query("differences_in_files", _ROW_SQL)
def differences_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark, "files")
    file_sink(place)(_row_diff(spark, sf_dir), 7)
    back = spark.read.schema("op string, before struct<user:bigint,value:double>, after struct<user:bigint,value:double>, batch int").json(place).where("batch = 7")
    return back.select("op", F.coalesce("after.user", "before.user").alias("user"), F.col("before.value").alias("before"), F.col("after.value").alias("after"))


@_query("differences_as_lines", f"SELECT CASE op WHEN 'add' THEN '+ ' || user WHEN 'delete' THEN '- ' || user ELSE '~ ' || user END AS line FROM ({_ROW_SQL})")
def differences_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(_row_diff(spark, sf_dir), {"add": "+ {{user}}", "update": "~ {{after.user}}", "delete": "- {{before.user}}"})


@_query("differences_in_a_database", f"SELECT op, count(*) AS n FROM ({_ROW_SQL}) GROUP BY 1")
def differences_in_a_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through JDBC and back, with the embedded database that Spark brings, in the driver's process and on its disk."""
    with tempfile.TemporaryDirectory(prefix="tidegraph-") as own:
        url = f"jdbc:derby:{os.path.realpath(own)}/db;create=true"
        try:
            jdbc_sink(url, "told")(_row_diff(spark, sf_dir), 1)
            rows = jdbc_table(spark, url, "told", folder(spark, "told"))().groupBy("op").count().collect()
        finally:
            shut(spark, url)
    return spark.createDataFrame([(r.op, r["count"]) for r in rows], "op string, n bigint")
