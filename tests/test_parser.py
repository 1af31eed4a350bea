import pytest

from tidegraph.ast import Binary, Call, Lit, Prop, Ref, Unary
from tidegraph.parser import ParseError, parse_cypher, parse_gql


def where(text):
    return parse_cypher(f"MATCH (a:A) WHERE {text} RETURN a").parts[0].where[0]


def test_and_or_share_a_level():
    assert where("a.x OR a.y AND a.z") == Binary("AND", Binary("OR", Prop(Ref("a"), "x"), Prop(Ref("a"), "y")), Prop(Ref("a"), "z"))


def test_precedence():
    assert where("1 + 2 * 3 = 7") == Binary("=", Binary("+", Lit(1), Binary("*", Lit(2), Lit(3))), Lit(7))
    assert where("2 * 3 ^ 2 > 0") == Binary(">", Binary("*", Lit(2), Binary("^", Lit(3), Lit(2))), Lit(0))
    assert where("NOT a.x = 1") == Unary("NOT", Binary("=", Prop(Ref("a"), "x"), Lit(1)))


def test_patterns():
    q = parse_cypher("MATCH (a:A|B {k: 1})-[r:R]->(b)<-[:S]-(c), (a)-[:T]-(d) OPTIONAL MATCH (d)-[:U]->(e) RETURN a")
    first, second, third = q.parts[0].paths
    assert first.nodes[0].labels == ("A", "B") and [r.direction for r in first.relations] == ["right", "left"]
    assert second.relations[0].direction == "either" and third.optional and not first.optional


def test_names_of_items():
    q = parse_cypher("MATCH (a:A) RETURN a.x, a, toUpper(a.y), a.x + 1, CASE WHEN true THEN 1 END, [1], {k: 1}, [x IN [1] | x]")
    assert [i.name for i in q.parts[0].items] == ["x", "a", "toUpper", "expression", "case", "list", "object", "iterator"]


def test_keywords_comments_ticks():
    q = parse_cypher("match (a:`My Label`) // note\n where a.`x y` = 'it' return a.`x y` as v")
    assert q.parts[0].paths[0].nodes[0].labels == ("My Label",) and q.parts[0].items[0].name == "v"
    assert parse_cypher("MATCH (a:A) RETURN ext.previousValue(a.x)").parts[0].items[0].expr == Call("ext.previousValue", (Prop(Ref("a"), "x"),))


def test_chained_parts():
    q = parse_cypher("MATCH (a:A) WITH a.x AS x, count(a) AS n WHERE n > 1 RETURN x")
    assert len(q.parts) == 2 and not q.parts[0].where and len(q.parts[1].where) == 1


@pytest.mark.parametrize("text", ["MATCH (a:A)", "MATCH (a:A) SET a.x = 1 RETURN a", "MATCH (a)-[*1..2]-(b) RETURN a", "MATCH (a:A) RETURN a ORDER BY a", "MATCH (a:A) WITH a MATCH (b:B) RETURN b", "RETURN ?"])
def test_refused(text):
    with pytest.raises(ParseError):
        parse_cypher(text)


def test_gql_statements():
    q = parse_gql("MATCH (a:A) LET y = a.x * 2 FILTER y > 1 YIELD a.k AS k, y RETURN k, sum(y) AS s GROUP BY k NEXT FILTER s > 2 RETURN max(s) AS m")
    assert [i.name for i in q.parts[-1].items] == ["m"] and q.parts[-2].keys == [Ref("k")]


@pytest.mark.parametrize("text", ["MATCH (a:A) RETURN a.x AS x, a.y AS y, count(a) AS n GROUP BY x", "MATCH (a:A) YIELD a.x + 1 RETURN 1", "MATCH (a:A) YIELD b RETURN b", "MATCH (a:A) RETURN a NEXT MATCH (b:B) RETURN b"])
def test_gql_refused(text):
    with pytest.raises(ParseError):
        parse_gql(text)
