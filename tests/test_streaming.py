import datetime as dt
import json
import time

import pytest

from tidegraph.operators import Decoder, ParseJson, Pipeline, Promote, Relabel, Unwind
from tidegraph.operators.middleware import Map, Mapping
from tidegraph.sources import MappingRule, file_sink, json_folder, log_sink, map_records, memory_sink, mock_changes, script_file
from tidegraph.streaming import CHANGES, ContinuousQuery, current_elements, element_versions
from tidegraph.types import LoweringError

TANKS = {"Tank": {"name": "string", "temp": "bigint"}, "Site": {"name": "string"}}
STANDS = {"STANDS_ON": ("Tank", "Site", {})}


def node(id_, label, op="insert", at=0, **props):
    return {"op": op, "element_id": id_, "labels": [label], "properties": props, "effective_from": at}


def link(a, b, op="insert"):
    return {"op": op, "element_type": "relation", "element_id": f"{a}-{b}", "labels": ["STANDS_ON"], "src_id": a, "dst_id": b}


def short(step):
    return [(r.op, tuple(r.before) if r.before else None, tuple(r.after) if r.after else None) for r in step]


def test_rows_change_by_change(spark):
    q = ContinuousQuery("MATCH (r:Tank) WHERE r.temp > 10 RETURN r.name AS name, r.temp AS temp", TANKS)
    steps = q.steps(spark, [node("r1", "Tank", name="R", temp=5), node("r1", "Tank", "update", temp=20), node("r1", "Tank", "delete"), node("r1", "Tank", "delete"), node("r2", "Tank", "update", temp=30)])
    assert [short(s) for s in steps] == [[], [("add", None, ("R", 20))], [("delete", ("R", 20), None)], [], [("add", None, (None, 30))]]


def test_groups_change_by_change(spark):
    q = ContinuousQuery("MATCH (r:Tank)-[:STANDS_ON]->(f:Site) RETURN f.name AS f, count(r) AS n, max(r.temp) AS m", TANKS, STANDS)
    steps = q.steps(spark, [node("f", "Site", name="F"), node("r", "Tank", temp=1), link("r", "f"), node("r", "Tank", "update", temp=3), node("r", "Tank", "update", temp=3), link("r", "f", "delete")])
    assert [short(s) for s in steps] == [[], [], [("aggregation", ("F", 0, None), ("F", 1, 1.0))], [("aggregation", ("F", 1, 1.0), ("F", 1, 3.0))], [], [("aggregation", ("F", 1, 3.0), ("F", 0, None))]]
    assert steps[2][0].default_before and steps[5][0].default_after and steps[3][0].grouping_keys == ["f"]


def test_stream_matches_batch_and_survives_restart(spark, tmp_path):
    q = ContinuousQuery("MATCH (r:Tank)-[:STANDS_ON]->(f:Site) RETURN f.name AS f, count(r) AS n", TANKS, STANDS)
    (tmp_path / "in").mkdir()
    got, n = [], 0
    for name, batch in (("a", [node("f", "Site", name="F"), node("r", "Tank", temp=1), link("r", "f")]), ("b", [node("s", "Tank", temp=2), link("s", "f")])):
        lines = []
        for c in batch:
            lines.append(json.dumps({"seq": n, "source_id": "t", "element_type": "node", "effective_from": 0} | c | {"properties": json.dumps(c.get("properties", {}))}))
            n += 1
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))
        q.start(json_folder(spark, str(tmp_path / "in")), str(tmp_path / "state"), memory_sink(got)).awaitTermination(120)
    assert [(b, tuple(r.before), tuple(r.after)) for b, r in got] == [(0, ("F", 0), ("F", 1)), (1, ("F", 1), ("F", 2))]
    assert [tuple(r) for r in q.results(spark, str(tmp_path / "state")).collect()] == [("F", 2)]


def test_time_alone_changes_results(spark):
    q = ContinuousQuery("MATCH (r:Tank) WHERE x.trueFor(r.temp > 10, duration({minutes: 10})) RETURN r.name AS name", TANKS)
    assert q.timed()
    log = spark.createDataFrame([ContinuousQuery.row(node("r1", "Tank", at=0, name="R", temp=20), 0)], CHANGES)
    at = lambda m: q.result(log, dt.datetime.fromtimestamp(m * 60, dt.timezone.utc))
    assert at(9).count() == 0 and at(10).count() == 1
    assert short(q.diff(at(9), at(10)).collect()) == [("add", None, ("R",))]


def test_current_elements_merge_updates(spark):
    changes = [node("a", "A", x=1, y=2), node("a", "A", "update", y=3), node("b", "A", x=1), node("b", "A", "delete"), node("b", "A", z=9)]
    found = {r.element_id: r.properties for r in current_elements(spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate(changes)], CHANGES)).collect()}
    assert found == {"a": {"x": "1", "y": "3"}, "b": {"z": "9"}}


@pytest.fixture(scope="module")
def pod(spark):
    props = {"a": {"b": 5}, "raw": "eyJ4IjoxfQ==", "zip": "07", "status": {"c": [{"id": "q"}, {"id": "w"}]}, "sig": [{"n": "Speed", "v": 3}, {"n": "X", "v": 4}]}
    return spark.createDataFrame([ContinuousQuery.row({"op": "insert", "element_id": "p", "labels": ["Pod"], "properties": props}, 0)], CHANGES)


def test_middleware_chain(pod):
    row = Pipeline((Promote((("$.a.b", "ab"),)), Decoder("base64", "raw", "dec"), ParseJson("dec", "js"), Relabel({"Pod": "Box"}))).apply(pod).head()
    props = json.loads(row.properties)
    assert row.labels == ["Box"] and props["ab"] == 5 and props["js"] == {"x": 1} and props["zip"] == "07"


@pytest.mark.parametrize(("encoding", "text", "wanted"), [("base64url", "aGk_", "hi?"), ("hex", "6869", "hi"), ("url", "a%20b", "a b"), ("json_escape", r"a\nb", "a\nb")])
def test_decoders(spark, encoding, text, wanted):
    df = spark.createDataFrame([ContinuousQuery.row({"op": "insert", "element_id": "p", "labels": ["T"], "properties": {"v": text}}, 0)], CHANGES)
    assert json.loads(Decoder(encoding, "v").apply(df).head().properties)["v"] == wanted


def test_error_policies(pod):
    assert Decoder("hex", "raw", on_error="skip").apply(pod).head().properties == pod.head().properties
    with pytest.raises(Exception, match="decoder"):
        Decoder("hex", "raw").apply(pod).collect()
    with pytest.raises(LoweringError):
        Promote((("zbad", "x"),)).apply(pod)


def test_unwind_and_map(pod):
    out = {r.element_id: r for r in Unwind("Pod", "$.status.c[*]", "Container", "$.id", "OWNS").apply(pod).collect()}
    assert set(out) == {"p", "$unwind-$.status.c[*]-p-q", "$unwind-$.status.c[*]-p-w", "$unwind-$.status.c[*]-p-q$rel", "$unwind-$.status.c[*]-p-w$rel"}
    mapped = Map({("Pod", "insert"): (Mapping(selector="$.sig[?(@.n == 'Speed')]", label="Vehicle", id="$.zip", op="update", properties={"speed": "$selected.v", "zip": "$.zip", "kind": "car"}),)}).apply(pod).collect()
    assert [(r.op, r.labels, r.element_id, json.loads(r.properties)) for r in mapped] == [("update", ["Vehicle"], "07", {"speed": 3, "zip": "07", "kind": "car"})]


def test_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in [{"kind": "Header", "start_time": "2024-01-01T00:00:00Z", "description": ""}, {"kind": "Node", "id": "a", "labels": ["A"], "properties": {"x": 1}}, {"kind": "Relation", "id": "r", "labels": ["R"], "start_id": "a", "end_id": "a", "properties": {}}, {"kind": "Finish", "description": ""}, {"kind": "Node", "id": "late", "labels": ["A"], "properties": {}}]))
    rows = script_file(spark, str(tmp_path / "s.jsonl")).orderBy("seq").collect()
    assert [(r.element_type, r.element_id) for r in rows] == [("node", "a"), ("relation", "r")] and rows[0].effective_from == 1704067200000
    assert mock_changes(spark, 7, "sensor", 3).where("op = 'update'").count() == 4
    records = spark.createDataFrame([('{"id": 5, "kind": "new", "t": "2024-01-01T00:00:00Z", "v": 1.5}',), ('{"id": 6, "kind": "other"}',)], "value string")
    rule = MappingRule("tank-{$.id}", ("Tank",), {"v": "$.v"}, when=("$.kind", "equals", "new"), effective_from="$.t", effective_format="iso8601")
    (row,) = map_records(records, [rule]).collect()
    assert (row.element_id, row.effective_from, row.properties) == ("tank-5", 1704067200000, '{"v":1.5}')


def test_sinks(spark, tmp_path):
    q = ContinuousQuery("MATCH (r:Tank) RETURN r.name AS name, r.temp AS temp", TANKS)
    schema = "name string, temp bigint"
    diff = q.diff(spark.createDataFrame([("old", 1)], schema), spark.createDataFrame([("new", 2)], schema))
    lines = []
    log_sink({"add": "+ {{after.name}} {{temp}}", "delete": "- {{before.name}}"}, lines.append)(diff, 0)
    assert sorted(lines) == ["+ new 2", "- old"]
    file_sink(str(tmp_path / "out"))(diff, 3)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_updates_keep_their_row(spark):
    """A row is known by its elements: a change of values is an update with before and after."""
    q = ContinuousQuery("MATCH (t:Tank)-[:STANDS_ON]->(s:Site) WHERE t.temp < 100 RETURN s.name AS site, t.temp AS temp", TANKS, STANDS)
    steps = q.steps(spark, [node("s1", "Site", name="A"), node("t1", "Tank", temp=5), node("t2", "Tank", temp=5), link("t1", "s1"), link("t2", "s1"), node("t2", "Tank", "update", temp=7), node("s1", "Site", "update", name="B"), node("t1", "Tank", "update", temp=100), node("s1", "Site", "update", name="B")])
    assert [short(x) for x in steps[:5]] == [[], [], [], [("add", None, ("A", 5))], [("add", None, ("A", 5))]]
    assert short(steps[5]) == [("update", ("A", 5), ("A", 7))]
    assert sorted(short(steps[6])) == [("update", ("A", 5), ("B", 5)), ("update", ("A", 7), ("B", 7))]
    assert short(steps[7]) == [("delete", ("B", 5), None)] and steps[8] == []


def test_earlier_values(spark):
    changes = [node("t1", "Tank", at=0, name="T", temp=20), node("t1", "Tank", "update", at=1000, temp=25), node("t1", "Tank", "update", at=2000, temp=25), node("t2", "Tank", at=2500, name="U", temp=1), node("t1", "Tank", "delete", at=3000), node("t1", "Tank", at=4000, name="T", temp=9)]
    log = lambda n: spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate(changes[:n])], CHANGES)
    q = ContinuousQuery("MATCH (t:Tank) RETURN t.name AS name, t.temp AS now, x.previousValue(t.temp, 0) AS before, x.previousDistinctValue(t.temp) AS other", TANKS)
    want = [[("T", 20, 0, None)], [("T", 25, 20, 20)], [("T", 25, 25, 20)], [("T", 25, 25, 20), ("U", 1, 0, None)], [("U", 1, 0, None)], [("T", 9, 0, None), ("U", 1, 0, None)]]
    # worked out from the versions of the elements there are now ...
    assert [sorted(tuple(r) for r in q.result(log(n)).collect()) for n in range(1, 7)] == want
    # ... and kept from change to change
    live = {}
    for step, rows in zip(q.steps(spark, changes), want):
        for d in step:
            live.pop(d.before.name if d.before else None, None)
            if d.after:
                live[d.after.name] = tuple(d.after)
        assert sorted(live.values()) == rows


def test_previous_value_of_an_aggregate(spark):
    q = ContinuousQuery("MATCH (t:Tank)-[:STANDS_ON]->(s:Site) WITH s, sum(t.temp) AS total WHERE total > x.previousValue(total, 0) RETURN s.name AS site, total", TANKS, STANDS)
    steps = q.steps(spark, [node("s", "Site", name="A", at=1), node("t", "Tank", temp=4, at=2), link("t", "s") | {"effective_from": 3}, node("t", "Tank", "update", temp=9, at=4), node("t", "Tank", "update", temp=3, at=5), node("t", "Tank", "update", temp=5, at=6)])
    assert [short(x) for x in steps] == [[], [], [("add", None, ("A", 4.0))], [("update", ("A", 4.0), ("A", 9.0))], [("delete", ("A", 9.0), None)], [("add", None, ("A", 5.0))]]


def test_history_beside_the_current_state(spark):
    changes = [node("t1", "Tank", at=0, name="T", temp=20), node("t1", "Tank", "update", at=1000, temp=25), node("t1", "Tank", "update", at=2000, temp=31), node("t2", "Tank", at=500, name="U", temp=7), node("t2", "Tank", "delete", at=3000)]
    log = spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate(changes)], CHANGES)
    one = lambda text: [tuple(r) for r in ContinuousQuery(text, TANKS).result(log).collect()]
    assert one("MATCH (t:Tank) RETURN sum(x.retainHistory(t.temp)) AS all, sum(t.temp) AS now, count(t) AS n") == [(83.0, 31.0, 1)]
    assert one("MATCH (t:Tank) WITH t, x.getVersionByTimestamp(t, 1500) AS v RETURN v.temp AS old, t.temp AS now") == [(25, 31)]
    assert one("MATCH (t:Tank) RETURN size(x.getVersionsByTimeRange(t, 500, 2500)) AS a, size(x.getVersionsByTimeRange(t, 500, 2500, true)) AS b, size(x.getVersionsByTimeRange(t, 1000, 1000, true)) AS c") == [(2, 3, 1)]
    assert one("MATCH (t:Tank) WITH t, t.temp * 40 AS at RETURN size(x.getVersionsByTimeRange(t, 0, at)) AS n, x.getVersionByTimestamp(t, at) IS NULL AS none") == [(2, False)]


def test_true_for_counts_from_the_change_that_made_it_true(spark):
    q = ContinuousQuery("MATCH (t:Tank) WHERE x.trueFor(t.temp > 10, duration({minutes: 10})) RETURN t.name AS name", TANKS)
    minute = 60_000
    changes = [node("t1", "Tank", at=0, name="T", temp=20), node("t1", "Tank", "update", at=8 * minute, temp=30), node("t1", "Tank", "update", at=11 * minute, temp=5), node("t1", "Tank", "update", at=12 * minute, temp=15)]
    at = lambda m: dt.datetime.fromtimestamp(m * 60, dt.timezone.utc)
    log = lambda n: spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate(changes[:n])], CHANGES)
    counts = [(n, m, q.result(log(n), at(m)).count()) for n, m in ((2, 9), (2, 10), (2, 12), (3, 30), (4, 21), (4, 22))]
    assert counts == [(2, 9, 0), (2, 10, 1), (2, 12, 1), (3, 30, 0), (4, 21, 0), (4, 22, 1)]
    steps = q.steps(spark, [*changes, node("t1", "Tank", "update", at=23 * minute, temp=16)], now=[at(m) for m in (0, 10, 11, 12, 23)])
    assert [short(x) for x in steps] == [[], [("add", None, ("T",))], [("delete", ("T",), None)], [], [("add", None, ("T",))]]


def test_true_for_an_aggregate_by_group(spark):
    q = ContinuousQuery("MATCH (t:Tank) WHERE t.temp > 0 AND x.trueFor(sum(t.temp) > 10, duration({seconds: 5})) RETURN sum(t.temp) AS total, t.name AS name", TANKS)
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    changes = [node("a", "Tank", at=0, name="x", temp=8), node("b", "Tank", at=1000, name="x", temp=8), node("c", "Tank", at=1000, name="y", temp=3), node("d", "Tank", at=6000, name="y", temp=1), node("a", "Tank", "update", at=8000, temp=1)]
    steps = q.steps(spark, changes, now=[at(s) for s in (0, 1, 5, 6, 8)])
    assert [short(x) for x in steps] == [[], [], [], [("aggregation", (0.0, "x"), (16.0, "x"))], [("aggregation", (16.0, "x"), (0.0, "x"))]]


def test_sources_with_equal_identifiers_are_kept_apart(spark):
    tank = lambda source, **props: node("1", "Tank", **props) | {"source_id": source}
    site = lambda source, **props: node("9", "Site", **props) | {"source_id": source}
    near, across = link("1", "9") | {"source_id": "p"}, link("1", "9") | {"source_id": "p", "element_id": "z", "src_source_id": "q", "dst_source_id": "p"}
    log = spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate([tank("p", name="T"), tank("q", name="U"), site("p", name="A"), site("q", name="B"), near, across])], CHANGES)
    q = ContinuousQuery("MATCH (t:Tank)-[:STANDS_ON]->(s:Site) RETURN t.name AS t, s.name AS s, elementId(t) AS id", TANKS, STANDS)
    assert sorted(tuple(r) for r in q.result(log).collect()) == [("T", "A", "1"), ("U", "A", "1")]


def test_order_of_changes_decides_among_equal_times(spark):
    changes = [node(f"t{k}", "Tank", at=5, name=n, temp=k) for k, n in enumerate("dbca")]
    log = spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate(changes)], CHANGES).repartition(3)
    (row,) = ContinuousQuery("MATCH (t:Tank) RETURN collect(t.name) AS all, x.last(t.name) AS latest", TANKS).result(log).collect()
    assert row.all == list("dbca") and row.latest == "a"


def test_an_emptied_group_has_the_values_of_no_rows(spark):
    q = ContinuousQuery("MATCH (t:Tank) RETURN t.name AS name, count(t) * 2 AS twice, round(avg(t.temp)) AS mean, max(t.temp) AS most", TANKS)
    steps = q.steps(spark, [node("t", "Tank", name="T", temp=3), node("t", "Tank", "update", name="U"), node("t", "Tank", "delete")])
    empty = lambda n: (n, 0, 0.0, None)
    assert short(steps[0]) == [("aggregation", empty("T"), ("T", 2, 3.0, 3.0))] and short(steps[2]) == [("aggregation", ("U", 2, 3.0, 3.0), empty("U"))]
    assert sorted(short(steps[1])) == [("aggregation", ("T", 2, 3.0, 3.0), empty("T")), ("aggregation", empty("U"), ("U", 2, 3.0, 3.0))]


def test_versions_merge_by_life(spark):
    changes = [node("t", "Tank", name="T", temp=1), node("t", "Tank", "update", temp=2), node("t", "Tank", "delete"), node("t", "Tank", "update", temp=5), node("t", "Tank", "update", name=None)]
    log = spark.createDataFrame([ContinuousQuery.row(c, k) for k, c in enumerate(changes)], CHANGES)
    for names in (None, ["name", "temp"]):
        got = {r.seq: (r.properties, r.live, r.current) for r in element_versions(log, names).collect()}
        assert got == {0: ({"name": "T", "temp": "1"}, False, False), 1: ({"name": "T", "temp": "2"}, False, False), 3: ({"temp": "5"}, True, False), 4: ({"temp": "5", "name": None}, True, True)}


def test_server(spark, tmp_path):
    from tidegraph.server import Server

    (tmp_path / "in").mkdir()
    lines = [json.dumps({"seq": 1, "source_id": "t", "element_type": "node", "effective_from": 0} | node("r1", "Tank", name="R", temp=5) | {"properties": '{"name": "R", "temp": 5}'})]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    known = spark.createDataFrame([ContinuousQuery.row(node("r0", "Tank", name="Q", temp=1), 0)], CHANGES)
    got = []
    server = Server(spark, str(tmp_path / "state")).add_source("s", json_folder(spark, str(tmp_path / "in")), known)
    server.add_query("q", ContinuousQuery("MATCH (r:Tank) RETURN r.name AS name", TANKS), "s").add_reaction("m", "q", memory_sink(got))
    assert server.status("q") == "added" and server.dependencies() == [("s", "q"), ("q", "m")]
    server.start("q")
    server.queries["q"].stream.awaitTermination(120)
    assert server.status("q") == "stopped" and sorted(r.name for r in server.results("q").collect()) == ["Q", "R"] and len(got) == 2
    with pytest.raises(ValueError, match="feeds"):
        server.remove_source("s")


def test_server_follows_the_clock(spark, tmp_path):
    """A result that time alone changes reaches the reactions without a change and without a call."""
    from tidegraph.server import Server

    (tmp_path / "in").mkdir()
    change = {"seq": 1, "source_id": "t", "element_type": "node", "op": "insert", "element_id": "r1", "labels": ["Tank"], "effective_from": 0, "properties": '{"name": "R", "temp": 50}'}
    (tmp_path / "in" / "a.json").write_text(json.dumps(change))
    now, got = [59], []
    q = ContinuousQuery("MATCH (r:Tank) WHERE x.trueFor(r.temp > 10, 60000) RETURN r.name AS name", TANKS)
    server = Server(spark, str(tmp_path / "state")).add_source("s", json_folder(spark, str(tmp_path / "in")))
    server.add_query("q", q, "s").add_reaction("m", "q", memory_sink(got))
    server.start("q", clock=lambda: dt.datetime.fromtimestamp(now[0], dt.timezone.utc), tick_every=0.2)
    server.queries["q"].stream.awaitTermination(120)
    assert got == []
    now[0] = 60
    for _ in range(600):
        if got:
            break
        time.sleep(0.1)
    server.stop("q")
    assert [(r.op, r.after.name) for _, r in got] == [("add", "R")]


def test_ticks_between_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    change = {"seq": 1, "source_id": "t", "element_type": "node", "op": "insert", "element_id": "r1", "labels": ["Tank"], "effective_from": 0, "properties": '{"name": "R", "temp": 50}'}
    (tmp_path / "in" / "a.json").write_text(json.dumps(change))
    q = ContinuousQuery("MATCH (r:Tank) WHERE x.trueFor(r.temp > 10, 60000) RETURN r.name AS name", TANKS)
    at = lambda s: lambda: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    got, state = [], str(tmp_path / "state")
    run = lambda s: q.start(json_folder(spark, str(tmp_path / "in")), state, memory_sink(got), clock=at(s)).awaitTermination(120)
    run(30)
    assert got == [] and q.tick(spark, state, at(59)).count() == 0
    assert short(q.tick(spark, state, at(60), memory_sink(got)).collect()) == [("add", None, ("R",))] and len(got) == 1
    # what a tick has reported is part of the result: neither the next tick nor the next batch says it again
    assert q.tick(spark, state, at(61)).count() == 0
    (tmp_path / "in" / "b.json").write_text(json.dumps(change | {"seq": 2, "op": "update", "effective_from": 70_000, "properties": '{"temp": 60}'}))
    run(80)
    assert len(got) == 1 and [r.name for r in q.results(spark, state).collect()] == ["R"]
    (tmp_path / "in" / "c.json").write_text(json.dumps(change | {"seq": 3, "op": "update", "effective_from": 90_000, "properties": '{"temp": 1}'}))
    run(95)
    assert [(r.op, r.before.name) for _, r in got[1:]] == [("delete", "R")]


def test_changes_sent_again_are_left_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda seq, n: json.dumps({"seq": seq, "source_id": "t", "element_type": "node", "op": "insert", "element_id": f"t{n}", "labels": ["Tank"], "effective_from": 0, "properties": json.dumps({"name": f"n{n}"})})
    q, got = ContinuousQuery("MATCH (t:Tank) RETURN t.name AS name", TANKS), []
    for name, lines in (("a", [line(1, 1), line(2, 2)]), ("b", [line(2, 7), line(3, 3)])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))
        q.start(json_folder(spark, str(tmp_path / "in")), str(tmp_path / "state"), memory_sink(got), numbered=True).awaitTermination(120)
    assert sorted((b, r.after.name) for b, r in got) == [(0, "n1"), (0, "n2"), (1, "n3")]
