import pytest

from tidegraph.graph import Graph
from tidegraph.plans.compile import compile_query
from tidegraph.types import LoweringError


@pytest.fixture(scope="module")
def plant(spark):
    tanks = spark.createDataFrame([("r1", 20), ("r2", 30), ("r3", 40), ("r4", None)], "id string, temp bigint")
    sites = spark.createDataFrame([("f1", "F1"), ("f2", "F2"), ("f3", "F3")], "id string, name string")
    stands_on = spark.createDataFrame([("r1", "f1", 1.5), ("r2", "f1", 2.5), ("r3", "f2", 3.5), ("r4", "f2", 0.5)], "tank string, site string, w double")
    knows = spark.createDataFrame([("r1", "r2"), ("r2", "r1"), ("r3", "r3")], "a string, b string")
    g = Graph().add_nodes("Tank", tanks, "id").add_nodes("Site", sites, "id")
    return g.add_relations("STANDS_ON", stands_on, ("Tank", "tank"), ("Site", "site")).add_relations("FEEDS", knows, ("Tank", "a"), ("Tank", "b")).add_join("SAME", ("Tank", "temp"), ("Tank", "temp"))


def rows(graph, text, language="cypher"):
    return sorted(tuple(r) for r in compile_query(graph, text, language).collect())


def test_directions(plant):
    assert rows(plant, "MATCH (r:Tank)-[:STANDS_ON]->(f:Site) RETURN r.id, f.name") == rows(plant, "MATCH (f:Site)<-[:STANDS_ON]-(r:Tank) RETURN r.id, f.name")
    with pytest.raises(LoweringError):
        rows(plant, "MATCH (r:Tank)<-[:STANDS_ON]-(f:Site) RETURN r.id")
    assert rows(plant, "MATCH (a:Tank)-[:FEEDS]-(b:Tank) RETURN a.id AS a, b.id AS b") == [("r1", "r2"), ("r1", "r2"), ("r2", "r1"), ("r2", "r1"), ("r3", "r3")]


def test_relation_properties(plant):
    assert rows(plant, "MATCH (r:Tank)-[p:STANDS_ON {w: 2.5}]->(f:Site) RETURN r.id, p.w") == [("r2", 2.5)]
    assert rows(plant, "MATCH (r:Tank)-[p:STANDS_ON WHERE p.w > 2.0]->(:Site {name: 'F2'}) RETURN r.id") == [("r3",)]


def test_cycle_is_closed(plant):
    assert rows(plant, "MATCH (a:Tank)-[:FEEDS]->(b:Tank), (b)-[:FEEDS]->(a) RETURN a.id AS a, b.id AS b") == [("r1", "r2"), ("r2", "r1"), ("r3", "r3")]


def test_equal_keys_never_pair(plant):
    with pytest.raises(LoweringError):
        rows(plant, "MATCH (a:Tank)-[:SAME]-(b:Tank) RETURN a.id")


def test_optional(plant):
    assert rows(plant, "MATCH (f:Site) OPTIONAL MATCH (f)<-[:STANDS_ON]-(r:Tank WHERE r.temp > 25) RETURN f.name AS f, count(r) AS n, sum(r.temp) AS s, min(r.temp) AS m") == [("F1", 1, 30.0, 30.0), ("F2", 1, 40.0, 40.0), ("F3", 0, 0.0, None)]
    assert rows(plant, "MATCH (f:Site) OPTIONAL MATCH (f)<-[:STANDS_ON]-(r:Tank)-[:FEEDS]->(o:Tank) RETURN f.name AS f, coalesce(o.id, '-') AS o") == [("F1", "r1"), ("F1", "r2"), ("F2", "r3"), ("F3", "-")]


def test_disconnected_patterns_are_refused(plant):
    with pytest.raises(LoweringError):
        rows(plant, "MATCH (a:Tank), (b:Site) RETURN a.id, b.id")


def test_average_of_averages(plant):
    q = "MATCH (r:Tank)-[:STANDS_ON]->(f:Site) WITH f, avg(r.temp) AS t RETURN avg(t) AS all, count(f) AS sites"
    assert rows(plant, q) == [(32.5, 2)]


def test_returned_element(plant):
    row = compile_query(plant, "MATCH (f:Site {name: 'F1'}) RETURN f, elementId(f) AS id").head()
    assert row.f.name == "F1" and row.id == "f1"


def test_aggregates_without_rows(plant):
    assert rows(plant, "MATCH (r:Tank) WHERE r.temp > 100 RETURN count(r) AS n, sum(r.temp) AS s, avg(r.temp) AS a, max(r.temp) AS m") == [(0, 0.0, 0.0, None)]


def test_slope(spark):
    # deviations from the means (0, 3): x -2 -1 1 2, y -5 -1 1 5; sum of products 22, of squares 10
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate([(-2, -2), (-1, 2), (1, 4), (2, 8), (9, 9)])], "id int, x double, y double")
    g = Graph().add_nodes("Point", df, "id")
    assert abs(rows(g, "MATCH (p:Point) WHERE p.id < 4 RETURN t.linearGradient(p.x, p.y) AS s")[0][0] - 2.2) < 1e-12
    assert rows(g, "MATCH (p:Point) WHERE p.id > 2 RETURN t.linearGradient(p.x, p.y) AS s") == [(1 / 7,)]


def test_aggregates_in_filters_fold_by_the_groups_of_the_result(plant):
    q = "MATCH (t:Tank)-[:STANDS_ON]->(s:Site) WHERE sum(t.temp) > 45 RETURN s.name AS s, sum(t.temp) AS total"
    assert rows(plant, q) == [("F1", 50.0)]
    assert rows(plant, "MATCH (t:Tank)-[:STANDS_ON]->(s:Site) WHERE t.temp > 25 AND count(t) > 0 RETURN s.name AS s, count(t) AS n") == [("F1", 1), ("F2", 1)]
    assert rows(plant, "MATCH (t:Tank) WHERE t.temp > avg(t.temp) RETURN t.id AS id") == [("r3",)]  # no groups: all rows


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS x", "id * 3 AS y").write.parquet(str(tmp_path / "t"))
    g = Graph().add_nodes("T", spark.read.parquet(str(tmp_path / "t")), "id")
    plan = compile_query(g, "MATCH (t:T) WHERE t.x > 50 RETURN t.x AS x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,50)" in plan and "ReadSchema: struct<x:bigint>" in plan
