from tidemark.operators.coverage import Coverage, Reduction


def test_one_shot_drops_an_irrelevant_true_atom():
    k = Coverage()
    for choice in ("wx", "yz"):
        k.declare_choice(choice)
    k.add_nogood("w")
    assert k.disjoint_from_nogoods(["x", "z"], Reduction.ONE_SHOT) == ["x"] == k.disjoint_from_nogoods(["z", "x"], Reduction.ONE_SHOT)
    k.add_nogood("wy")
    assert k.disjoint_from_nogoods(["z", "x"], Reduction.ONE_SHOT) == ["x"]
    k.add_nogood("y")
    assert k.disjoint_from_nogoods(["z", "x"], Reduction.ONE_SHOT) == ["z", "x"]


def test_core_through_choices_in_between():
    """Region {c} is away because a makes b false, so d is true, so c is false: no choice has both a and c."""
    coverage = Coverage()
    for choice in (["a", "b"], ["b", "d"], ["d", "c"], ["p", "q"], ["s", "t"], ["v", "w"]):
        coverage.declare_choice(choice)
    coverage.add_nogood(["c"])
    given = ["p", "s", "a", "v"]
    assert coverage.disjoint_from_nogoods(given, Reduction.ONE_SHOT) == ["a"]
    for policy in (Reduction.IN_ORDER, Reduction.GREEDY):
        assert coverage.disjoint_from_nogoods(given, policy) == ["a"]
    assert coverage.disjoint_from_nogoods(given) == given
