import json
import os
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyspark
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidegraph.functions import FUNCTIONS
from tidegraph.graph import Graph
from tidegraph.plans.compile import compile_query
from tidegraph.sources import EventStream, HttpSource, PushSource, TablePoller, embedded, file_sink, jdbc_sink, jdbc_table, memory_sink, post_sink, procedure_sink, routed, snapshot_changes
from tidegraph.sources.sinks import log_sink
from tidegraph.streaming import ContinuousQuery
from tidegraph.types import LONG, Typed, lit

NODES = {"Pump": {"name": "string", "rate": "bigint"}}
QUERY = "MATCH (p:Pump) WHERE p.rate > 5 RETURN p.name AS name, p.rate AS rate"


@pytest.fixture
def derby(spark, tmp_path):
    """An embedded database: url of a JDBC connection that runs statements."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"

    def run(*statements):
        to = spark._jvm.java.sql.DriverManager.getConnection(url)
        for s in statements:
            to.createStatement().execute(s)
        to.close()

    return url, run


def followed(spark, query, stream, folder):
    got = []
    query.start(stream, folder, memory_sink(got)).awaitTermination(120)
    return [(r.op, tuple(r.before) if r.before else None, tuple(r.after) if r.after else None) for _, r in got]


def test_changes_pushed_by_the_process(spark, tmp_path):
    source, q = PushSource(spark, str(tmp_path / "in")), ContinuousQuery(QUERY, NODES)
    source.insert("a", ["Pump"], name="A", rate=9)
    source.insert("b", ["Pump"], name="B", rate=1)
    assert followed(spark, q, source.stream(), str(tmp_path / "s")) == [("add", None, ("A", 9))]
    source.update("a", ["Pump"], rate=8)
    source.delete("b", ["Pump"])
    assert followed(spark, q, source.stream(), str(tmp_path / "s")) == [("update", ("A", 9), ("A", 8))]
    with pytest.raises(ValueError, match="needs an op"):
        source.send([{"op": "upsert", "element_id": "x"}])


def test_events_over_http(spark, tmp_path):
    server = HttpSource(PushSource(spark, str(tmp_path / "in"), "plant"))
    post = lambda path, body: json.load(urlopen(Request(f"http://127.0.0.1:{server.port}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=20))
    node = lambda id_, **props: {"operation": "insert", "element": {"type": "node", "id": id_, "labels": ["Pump"], "properties": props}, "timestamp": 1_700_000_000_000_000_000}
    assert post("/sources/plant/events", node("a", name="A", rate=9))["accepted"] == 1
    more = [node("b", name="B", rate=7), {"operation": "delete", "id": "a", "labels": ["Pump"]}, {"operation": "insert", "element": {"type": "relation", "id": "r", "labels": ["FEEDS"], "from": "b", "to": "b", "properties": {}}}]
    assert post("/sources/plant/events/batch", {"events": more})["accepted"] == 3
    for path, body, status in (("/sources/other/events", node("x"), 400), ("/sources/plant/else", {}, 404), ("/sources/plant/events", {"operation": "merge"}, 400), ("/sources/plant/events", [], 400)):
        with pytest.raises(HTTPError) as wrong:
            post(path, body)
        assert wrong.value.code == status
    assert json.load(urlopen(f"http://127.0.0.1:{server.port}/health", timeout=20)) == {"status": "healthy"}
    server.stop()
    rows = {r.element_id: r for r in spark.read.json(str(tmp_path / "in")).where("op = 'insert'").collect()}
    assert rows["a"].effective_from == 1_700_000_000_000 and rows["r"].src_id == "b" and rows["b"].source_id == "plant"
    q = ContinuousQuery(QUERY, NODES)
    assert followed(spark, q, PushSource(spark, str(tmp_path / "in")).stream(), str(tmp_path / "s")) == [("add", None, ("B", 7))]


def test_polled_tables(spark, tmp_path, derby):
    url, run = derby
    run("CREATE TABLE pumps (id INT PRIMARY KEY, name VARCHAR(9), rate BIGINT, v INT)", "INSERT INTO pumps VALUES (1, 'A', 9, 1), (2, 'B', 3, 2)")
    nodes = {"Pump": {"NAME": "string", "RATE": "bigint"}}
    q = ContinuousQuery("MATCH (p:Pump) WHERE p.RATE > 5 RETURN p.NAME AS name, p.RATE AS rate", nodes)
    whole = TablePoller(spark, jdbc_table(spark, url, "pumps"), str(tmp_path / "w"), "Pump", "ID")
    newer = TablePoller(spark, jdbc_table(spark, url, "pumps"), str(tmp_path / "n"), "Pump", "ID", changed="V")
    assert (whole.poll(), newer.poll()) == (2, 2)
    assert followed(spark, q, whole.stream(), str(tmp_path / "ws")) == followed(spark, q, newer.stream(), str(tmp_path / "ns")) == [("add", None, ("A", 9))]
    run("UPDATE pumps SET rate = 7, v = 3 WHERE id = 2", "DELETE FROM pumps WHERE id = 1")
    assert (whole.poll(), newer.poll(), newer.poll()) == (2, 1, 0)
    assert sorted(followed(spark, q, whole.stream(), str(tmp_path / "ws"))) == [("add", None, ("B", 7)), ("delete", ("A", 9), None)]
    assert followed(spark, q, newer.stream(), str(tmp_path / "ns")) == [("add", None, ("B", 7))]


def test_snapshots_to_changes(spark):
    at = lambda rows: spark.createDataFrame(rows, "k int, v string, w double")
    got = {r.element_id: (r.op, json.loads(r.properties)) for r in snapshot_changes(at([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)]), at([(1, None, None), (3, "c", 2.0), (4, "d", 3.0)]), "T", "k").collect()}
    assert got == {"1": ("update", {"k": 1, "v": None, "w": None}), "2": ("delete", {}), "4": ("insert", {"k": 4, "v": "d", "w": 3.0})}


@pytest.fixture
def diff(spark):
    q = ContinuousQuery(QUERY, NODES)
    frame = lambda rows: spark.createDataFrame(rows, "name string, rate bigint, `@rid` string")
    return q.diff(frame([("A", 6, "1"), ("B", 7, "2"), ("C", 8, "3")]), frame([("A", 9, "1"), ("C", 8, "3"), ("D'); DROP", 9, "4")]))


def test_files_and_lines(spark, tmp_path, diff):
    file_sink(str(tmp_path / "out"))(diff, 3)
    file_sink(str(tmp_path / "out"))(diff, 3)  # a batch that runs again replaces what it wrote
    assert sorted((r.op, r.batch) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("add", 3), ("delete", 3), ("update", 3)]
    lines = []
    sink = routed({"q": {"update": "~ {{before.rate}}>{{rate}}"}}, {"add": "+ {{name}}", "update": "u"}, lambda templates: log_sink(templates, lines.append))
    sink("q")(diff, 0)
    sink("other")(diff, 0)
    assert sorted(lines) == ["+ D'); DROP", "+ D'); DROP", "u", "~ 6>9"]


def test_databases(spark, diff, derby):
    url, run = derby
    run("CREATE TABLE live (name VARCHAR(20), rate BIGINT)", "INSERT INTO live VALUES ('A', 6), ('B', 7), ('C', 8)")
    sink = procedure_sink(url, {"add": "INSERT INTO live VALUES ({{after.name}}, {{after.rate}})", "update": "UPDATE live SET rate = {{after.rate}} WHERE name = {{before.name}}", "delete": "DELETE FROM live WHERE name = {{before.name}}"})
    sink(diff, 0)
    assert sorted(tuple(r) for r in jdbc_table(spark, url, "live")().collect()) == [("A", 9), ("C", 8), ("D'); DROP", 9)]
    jdbc_sink(url, "told")(diff, 4)
    assert sorted((r.batch, r.op) for r in jdbc_table(spark, url, "told")().collect()) == [(4, "add"), (4, "delete"), (4, "update")]


def test_databases_inside_the_driver(spark, tmp_path, derby, monkeypatch):
    url, run = derby
    run('CREATE TABLE told (AFTER CLOB, "op" VARCHAR(9) NOT NULL, BATCH INT)')  # another case and order than the rows have
    rows = [(k, f"o{k}", None if k % 3 else f"é'\n日 {k}") for k in range(2500)]
    frame = spark.createDataFrame(rows, "batch int, op string, after string").repartition(7)
    embedded.append(frame, url, "told", {})
    monkeypatch.setattr(embedded, "SLICE", 600)
    back = embedded.read(spark, url, "told", str(tmp_path / "place"), {})
    assert back.columns == ["AFTER", "op", "BATCH"] and sorted((r.BATCH, r.op, r.AFTER) for r in back.collect()) == rows
    with pytest.raises(Exception, match="truncation error"):  # the last of the rows does not fit: none is kept
        embedded.append(spark.createDataFrame([*rows, (1, "far too long a name", None)], frame.schema).coalesce(1), url, "told", {})
    assert embedded.read(spark, url, "told", str(tmp_path / "place"), {}).count() == jdbc_table(spark, url, "told")().count() == 2500
    run("CREATE TABLE bare (k BIGINT, t TIMESTAMP, d DECIMAL(9, 2))")
    bare = embedded.read(spark, url, "bare", str(tmp_path / "place"), {})
    assert bare.collect() == [] and bare.dtypes == jdbc_table(spark, url, "bare")().dtypes == [("K", "bigint"), ("T", "timestamp"), ("D", "decimal(9,2)")]
    embedded.shut(spark, url)
    embedded.shut(spark, f"jdbc:derby:{tmp_path}/never")
    monkeypatch.setattr("tidegraph.sources.push.beyond_executors", lambda *_: True)
    with pytest.raises(ValueError, match="name a place"):
        jdbc_table(spark, url, "told")


_ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.cores.max", "2").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared").getOrCreate()
)
print("told", sorted(map(tuple, __spark_entry__.queries()["differences_in_a_database"](spark, "/root/testdata/sf0.01").collect())))
spark.stop()
"""


def test_differences_in_a_database_on_a_cluster(spark, tmp_path):
    """Executors in processes of their own cannot open the driver's database."""
    home = tmp_path / "home"  # executors write their logs to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": str(Path(__file__).parents[1]), "PYSPARK_PYTHON": sys.executable}
    made = subprocess.run([sys.executable, "-c", _ON_A_CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    here = __spark_entry__.queries()["row_differences"](spark, "/root/testdata/sf0.01").groupBy("op").count().collect()
    assert f"told {sorted(map(tuple, here))}" in made.stdout, made.stderr[-3000:]


def test_posts_are_tried_again(diff):
    seen, fails = [], [2]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            fails[0] -= 1
            if fails[0] < 0:
                seen.append(body)
            self.send_response(200 if fails[0] < 0 else 503)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post_sink(f"http://127.0.0.1:{server.server_port}/", wait=0.01, batch=10)(diff.coalesce(1), 0)
    assert len(seen) == 1 and sorted(x["op"] for x in seen[0]) == ["add", "delete", "update"]
    fails[0] = 10
    with pytest.raises(Exception, match="503"):
        post_sink(f"http://127.0.0.1:{server.server_port}/", wait=0.01, retries=1)(diff.coalesce(1), 0)
    server.shutdown()


def test_server_sent_events(diff):
    stream = EventStream({"update": "{{name}} {{rate}}"})
    answer = urlopen(f"http://127.0.0.1:{stream.port}/events", timeout=20)
    while not stream.clients:
        pass
    stream(diff, 0)
    assert answer.readline() == b"data: A 9\n"
    stream.stop()


def test_functions_of_every_kind(spark):
    own = FUNCTIONS.copy()
    own.register("double_it")(lambda ctx, x: Typed(x.col * 2, x.type))
    own.register_lazy("if_known")(lambda ctx, e, other: ctx.value(e) if getattr(e, "name", "") in ctx.scope.slots or getattr(e, "key", "") == "rate" else ctx.value(other))
    own.register_aggregating("countOver")(lambda ctx, args, live: Typed(F.count(live(F.when(args[0].col > args[1].col, 1))), LONG))
    own.register_mutating("asOf")(lambda ctx, at, e: (__import__("dataclasses").replace(ctx, now=F.timestamp_millis(F.lit(at.value))), e))
    g = Graph().add_nodes("Pump", spark.createDataFrame([("a", 9), ("b", 3), ("c", 7)], "name string, rate bigint"), "name")
    one = lambda text: compile_query(g, text, registry=own).collect()
    assert [tuple(r) for r in one("MATCH (p:Pump) RETURN countOver(p.rate, 5) AS n, double_it(sum(p.rate)) AS s")] == [(2, 38.0)]
    assert sorted(tuple(r) for r in one("MATCH (p:Pump) WHERE x.asOf(10, x.trueLater(p.rate > 5, 10)) AND NOT x.asOf(9, x.trueLater(p.rate > 5, 10)) RETURN if_known(p.rate, unknown_name) AS r")) == [(7,), (9,)]
    assert lit(1).literal == 1


def test_bare_comprehensions(spark):
    g = Graph().add_nodes("Pump", spark.createDataFrame([(1, [1, 2, 3])], "id int, l array<bigint>"), "id")
    (row,) = compile_query(g, "MATCH (p:Pump) RETURN x IN p.l WHERE x > 1 AS big, y IN p.l | y * 2 AS twice, size(z IN p.l WHERE z < 3 | z) AS n, (w IN p.l WHERE w = 1) AS one, 2 IN p.l AS has").collect()
    assert tuple(row) == ([2, 3], [2, 4, 6], 2, [1], True)
