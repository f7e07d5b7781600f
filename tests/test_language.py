import pytest

from sparkweave.plans import planner
from sparkweave.plans.algebra import Among, Compare, DeleteData, DeleteWhere, Id, Insert, Pattern, Reaches, Rename, Select, Text, Var
from sparkweave.plans.parser import ParseError, parse


def test_select():
    q = parse("PREFIX e: <http://e/> select distinct ?b ?a where { ?a 7 ?b ; 6 50, 51 . ?b e:x 'it''' . filter(?a != 4) } limit 3".replace("'it'''", '"it"'))
    assert isinstance(q, Select) and q.modifier == "distinct" and q.limit == 3 and q.columns() == ["b", "a"]
    assert q.where.patterns == [Pattern(Var("a"), Id(7), Var("b")), Pattern(Var("a"), Id(6), Id(50)), Pattern(Var("a"), Id(6), Id(51)), Pattern(Var("b"), Text("http://e/x", True), Text("it"))]
    assert q.where.filters == [Compare(Var("a"), Id(4), False)]


def test_star_is_by_name_and_hides_blanks():
    assert parse("select * where { ?z 1 [ 2 ?a ] . _:q 3 ?m . }").columns() == ["a", "m", "z"]


def test_filters_and_groups():
    q = parse("select ?x where { { ?x 1 2 . } union { ?x 1 3 . } { ?x 4 ?y } optional { ?y 5 ?z } filter(?x in 1, 2) filter(?x reaches 9 via 7) # end\n}")
    assert len(q.where.unions[0]) == 2 and len(q.where.optionals) == 1 and len(q.where.patterns) == 1
    assert q.where.filters == [Among(Var("x"), (Id(1), Id(2))), Reaches(Var("x"), Id(9), Id(7))]


def test_updates():
    assert isinstance(parse("insert data { 1 2 3 . }"), Insert)
    assert isinstance(parse("DELETE DATA { 1 2 3 . 4 5 6 }"), DeleteData)
    assert parse("delete { ?s 2 3 . }") == DeleteWhere(Pattern(Var("s"), Id(2), Id(3)))
    assert isinstance(parse("delete { 1 7 ?o } insert { 9 7 ?o }"), Rename)


@pytest.mark.parametrize("bad", ["", "select where { ?x 1 2 }", "select ?x from { }", "select ?x where { ?x 1 }", "select ?x where { ?x 1 2", "select ?x where { ?x 1 2 } limit 0", "prefix a: <x> prefix a: <y> select ?x where { ?x 1 2 }", "insert data { ?x 1 2 }", "select ?x where { ?x 1 2 } rest", "delete { ?s ?p 1 }"])
def test_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def _p(text):
    return parse(f"select * where {{ {text} }}").where.patterns


def test_order_starts_small_and_stays_connected():
    patterns = _p("?o 4 ?c . ?c 2 5 . ?n 9 ?m . ?n 8 1 .")
    cost = dict(zip(patterns, [1000, 10, 500, 100], strict=True))
    assert planner.order(patterns, cost.__getitem__) == [patterns[1], patterns[0], patterns[3], patterns[2]]


def test_shapes():
    assert planner.shape(_p("?x 1 ?y")) == "single"
    assert planner.shape(_p("?x 1 ?y . ?x 2 ?z")) == "star"
    assert planner.shape(_p("?x 1 ?y . ?y 2 ?z . ?z 3 ?w")) == "acyclic"
    assert planner.shape(_p("?x 1 ?y . ?y 2 ?z . ?z 3 ?x")) == "cyclic"
