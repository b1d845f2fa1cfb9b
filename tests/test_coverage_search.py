"""Large and empty sets, other atoms than text, budgets."""

import time

import pytest

from tidemark.functions.terms import RuleError
from tidemark.operators.coverage import Coverage, Reduction, gaps, overlaps


def test_many_choices_need_no_recursion():
    k = Coverage()
    for i in range(3000):
        k.declare_choice([f"a{i}", f"b{i}"])
    k.add_nogood(["a0", "b1"])
    began = time.time()
    found = k.gap_witness()
    assert len(found) == 3000 and not {"a0", "b1"} <= set(found) and time.time() - began < 20


def test_a_budget_ends_a_search():
    k = Coverage(budget=50)
    for i in range(9):  # nine things in eight places
        k.declare_choice([(i, p) for p in range(8)])
    for p in range(8):
        for i in range(9):
            for j in range(i):
                k.add_nogood([(i, p), (j, p)])
    with pytest.raises(RuleError, match="timed out"):
        k.gap_witness()


def test_atoms_of_any_kind():
    k = Coverage()
    k.declare_choice([1, 2])
    k.declare_choice([("x", 1), ("x", 2)])
    k.add_nogood([1])
    assert k.disjoint_from_nogoods([2, ("x", 1)], Reduction.GREEDY) == [2]
    two = Coverage(positive=False)
    two.declare_choice([1, 2])
    two.add_nogood([1])
    assert two.disjoint_from_nogoods([(2, True)]) == [(2, True)] and sorted(two.gap_witness()) == [(1, False), (2, True)]


@pytest.mark.parametrize("choices, regions", [([["x", "y"]], [[]]), ([["x", "y"], []], []), ([["x"], []], [["x"]]), ([[1, 2], [2, 3]], [[3]]), ([["x", "y"]], [["x"]])])
def test_tables_say_the_same_as_the_search(spark, choices, regions):
    k = Coverage(positive=False)
    for c in choices:
        k.declare_choice(c)
    for r in regions:
        k.add_nogood(r)
    found, witness = gaps(spark, *k.frames(spark)).collect(), k.gap_witness()
    assert bool(found) == (witness is not None)
    covered = overlaps(spark, *k.frames(spark), []).collect()
    if regions:
        assert bool(covered) == (k._solve({}, True) is not None)
