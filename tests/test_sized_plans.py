"""Joins are ordered by the sizes of what is joined, where these are known."""

from tidemark.functions.terms import Atom, Body, variables
from tidemark.operators.lower import lower
from tidemark.operators.relation import Relation, spread
from tidemark.plans.planner import join_order, plan_body, sized_order

c, o, s, n, p = variables("c o s n p")
ATOMS = (Atom("placed", c, o), Atom("item", o, p, s), Atom("lives", c, n), Atom("sits", s, n))
SIZES = {"placed": [9e6, 6e5, 9e6], "item": [36e6, 9e6, 1.2e6, 6e4], "lives": [9e5, 9e5, 25], "sits": [6e4, 6e4, 25]}


def test_a_column_of_few_values_is_joined_last():
    assert [a.predicate for a in join_order(ATOMS)][2] == "sits"  # by the atoms alone: all suppliers of the nation for each order
    assert [a.predicate for a in sized_order(ATOMS, SIZES)] in (["lives", "placed", "item", "sits"], ["placed", "lives", "item", "sits"])


def test_crosses_come_last_and_constants_first():
    atoms = (Atom("a", c), Atom("b", o), Atom("ab", c, o), Atom("big", o, 7))
    order = sized_order(atoms, {"a": [5, 5], "b": [5, 5], "ab": [25, 5, 5], "big": [1e6, 1e3, 1e6]})
    assert [a.predicate for a in order][0] in ("big", "b") and all(set(order[i].vars) & {v for a in order[:i] for v in a.vars} for i in range(1, 4))


def test_rows_are_the_same(spark):
    facts = {"placed": [(i % 5, i) for i in range(20)], "item": [(i % 20, i, i % 7) for i in range(60)], "lives": [(i, i % 2) for i in range(5)], "sits": [(i, i % 2) for i in range(7)]}
    facts = {k: Relation.literal(spark, len(v[0]), v) for k, v in facts.items()}
    body, arities = Body([c, s], ATOMS), {k: r.shape for k, r in facts.items()}
    sizes = spread(facts)
    assert sizes["item"][0] == 60 and sizes["lives"][1:] == [5, 2]
    found = [sorted(map(tuple, lower(plan_body(body, arities, x), facts, spark).df.collect())) for x in (None, sizes)]
    assert found[0] and found[0] == found[1]
