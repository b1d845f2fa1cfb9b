import itertools

import pytest

from tidemark.functions.terms import Atom, Body, Rule, RuleError, Search, Var, instantiate, predicate_shapes, rule, search, variables
from tidemark.plans.ir import Unit, antijoin, join, natural_join, project, scan
from tidemark.plans.planner import join_order, plan_body, plan_search

x, y, z, w = variables("x y z w")


def test_variables_are_distinct_and_ordered():
    a, b = Var("a"), Var("a")
    assert a != b and a < b and len({a, b}) == 2 and repr(a) == "a"


def test_captures_follow_creation_order():
    assert Atom("p", z, x, 1, z).vars == (x, z)
    assert Body([z, x], [Atom("p", z, x)]).captures == (x, z)


def test_body_must_capture_its_own_variables():
    with pytest.raises(RuleError, match="occur in no atom"):
        Body([w], [Atom("p", x, y)])
    assert Body.partial([x, w], [Atom("p", x, y)]).captures == (x,)


def test_rule_and_search_validation():
    with pytest.raises(RuleError, match="not captured"):
        Rule(Body([x], [Atom("p", x, y)]), Atom("q", y))
    with pytest.raises(RuleError, match="does not capture"):
        Search(Body([x], [Atom("p", x, y)]), Body([y], [Atom("q", y)]))
    assert Search(Body([x], [Atom("p", x, y)])).alternatives == ()
    a, b, c = ([Atom("t", k)] for k in (1, 2, 3))
    assert len({search(Body([], []), *p) for p in itertools.permutations((a, b, c))}) == 1


def test_shapes():
    assert predicate_shapes([rule(Atom("q", x, y, x), Atom("p", x), Atom("dr", x, y))]) == {"p": 1, "dr": 2, "q": 3}
    with pytest.raises(RuleError, match="is used with"):
        predicate_shapes([rule(Atom("p", x), Atom("p", x, y))])


def test_instantiate_backfills_once():
    asked = []
    row = instantiate(Atom("p", x, y, z, x, z), {x: 2, y: 3}, lambda v: asked.append(v) or 10)
    assert row == (2, 3, 10, 2, 10) and asked == [z]


foo, bar, bar3 = scan(Atom("foo", x, y)), scan(Atom("bar", y, z)), scan(Atom("bar3", x, y, z))


def test_plan_shapes():
    assert scan(Atom("foo", y, x)).shape == (x, y)
    assert project(foo, [y, x, x]).shape == (y, x, x)
    assert join((foo, bar), [y], [x, z]).key == (y,)
    assert natural_join((foo, bar)).shape == (x, y, z)
    assert natural_join((scan(Atom("foo", x, y)), scan(Atom("baz", z, w)))).key == ()
    assert antijoin(foo, [y], [project(bar, [y])]).shape == foo.shape
    assert antijoin(foo, [y], []).subtrahends == ()


@pytest.mark.parametrize(
    "build, message",
    [
        (lambda: scan(Atom("foo", x, y), 3), "columns"),
        (lambda: project(foo, [z]), "not in the input"),
        (lambda: join((foo, bar), [x], [z]), "not in both"),
        (lambda: join((foo, bar), [y], [w]), "in no input"),
        (lambda: join((foo, bar3), [x], [y]), "both inputs but not in the key"),
        (lambda: join((foo,), [x], [x]), "two inputs"),
        (lambda: natural_join((foo, bar, bar3)), "two inputs"),
        (lambda: antijoin(foo, [y], [bar]), "shape of the key"),
        (lambda: antijoin(foo, [x, y], [project(foo, [y, x])]), "shape of the key"),
        (lambda: antijoin(foo, [z], [project(bar, [z])]), "does not hold the key"),
        (lambda: plan_body(Body([x], [Atom("nope", x)]), {}), "not found"),
    ],
)
def test_plan_errors(build, message):
    with pytest.raises(RuleError, match=message):
        build()


def test_planner():
    assert plan_body(Body([], []), {}) == Unit()
    atoms = (Atom("a", x, y), Atom("b", z, w), Atom("c", y, z), Atom("d", x, 3))
    assert [a.predicate for a in join_order(atoms)] == ["d", "a", "c", "b"]  # no cross product though b sorts before c
    p = plan_search(search(Body([x], [Atom("p", x, y)]), [Atom("q", x, z)]), {"p": 2, "q": 2})
    assert p.shape == (x,) and p.key == (x,)
