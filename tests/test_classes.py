"""Closures by classes of values that reach each other, against naive evaluation."""

import random

import pytest

from tests.test_saturation_and_epochs import SYM, TRANS, naive, rows
from tidemark.functions.terms import Atom, rule, variables
from tidemark.operators import classes, numbers
from tidemark.operators.relation import Relation
from tidemark.operators.saturate import closing, saturate
from tidemark.streaming.session import Deduction

x, y, z = variables("x y z")
IDS = [-(2**63), -65, -64, -1, 0, 1, 2, 62, 63, 64, 127, 128, 2**63 - 1]
BACK = rule(Atom("edge", y, x), Atom("back", x, y))
GOAL = rule(Atom("goal"), Atom("edge", 0, 63))


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(classes, "CLOSE_FROM", 0)
    monkeypatch.setattr(classes, "LEAST_GAIN", 0)
    return monkeypatch


def numbered(monkeypatch):
    monkeypatch.setattr(numbers, "NUMBER_FROM", 0)
    monkeypatch.setattr(numbers, "LEAST_GAIN", 0)


def some(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(IDS), rng.choice(IDS)) for _ in range(n)]


@pytest.mark.parametrize(("rules", "n", "seed", "rounds", "at_once"), [([TRANS, GOAL], 14, 2, 16, 500_000), ([TRANS, SYM], 6, 3, 1, 1), ([TRANS, BACK], 9, 4, 1, 500_000)])
def test_closures(spark, always, rules, n, seed, rounds, at_once):
    """Few rounds leave classes in parts; a small bound makes all joins shuffle."""
    always.setattr(classes, "ROUNDS", rounds)
    always.setattr(classes, "BROADCAST_UP_TO", at_once)
    if BACK in rules:
        numbered(always)
    inputs = {"edge": some(seed, n)} | ({"back": some(seed + 10, 3)} if BACK in rules else {})
    found, want = saturate(spark, rules, {p: Relation.literal(spark, 2, r) for p, r in inputs.items()}), naive(rules, inputs)
    for p in want:
        assert [r if p != "goal" else () for r in rows(found[p])] == sorted(want[p]), p
    edge = found["edge"]
    assert edge.rows == len(want["edge"]) and rows(Relation.of_words(2, edge.words, numbers=edge.numbers)) == sorted(want["edge"])


def test_epochs(spark, always):
    rng, held, rules, before = random.Random(8), set(), [TRANS, GOAL], set()
    session = Deduction(spark, rules)
    for epoch in range(3):
        add, drop = some(20 + epoch, 8 if not epoch else 3), rng.sample(sorted(held), 2) if epoch > 1 else []
        add = [e for e in add if e not in held and e not in drop]
        held = (held | set(add)) - set(drop)
        session.insert("edge", sorted(set(add)))
        if drop:
            session.remove("edge", drop)
        session.advance(epoch)
        want = set(naive(rules, {"edge": held})["edge"])
        assert session.fixpoint.spans and set(rows(session.facts("edge"))) == want, epoch
        if epoch:
            changed = {(a, b, w) for a, b, w in map(tuple, session.changes("edge").df.select("_0", "_1", "_w").collect())}
            assert changed == {(*e, 1) for e in want - before} | {(*e, -1) for e in before - want}, epoch
        before = want


def test_a_chain_of_dense_parts_is_closed_as_one_class(spark):
    """Neighbouring parts share a value on either side, so all of them are one class: words for each value would be its square."""
    edges = [(p * 100 + a, p * 100 + (a + d) % 101) for p in range(20) for a in range(101) for d in range(1, 18)]
    session = Deduction(spark, [TRANS])
    session.insert("edge", edges)
    session.advance(1)
    facts = session.facts("edge")
    assert facts.rows == facts.df.count() == 2001**2
    assert session.fixpoint.spans["edge"].rows < 3 * 2001  # what is kept; the rounds before this kept the square


def test_which_rules_close():
    assert closing([TRANS], "edge") == ([], False) and closing([TRANS, SYM, BACK], "edge") == ([BACK], True)
    for wrong in (rule(Atom("edge", z, x), Atom("edge", x, y), Atom("edge", y, z)), rule(Atom("edge", x, z), Atom("edge", x, y), Atom("edge", z, y)), rule(Atom("edge", x, z), Atom("edge", x, y), Atom("back", y, z)), rule(Atom("edge", x, 5), Atom("edge", x, y), Atom("edge", y, 5))):
        assert closing([TRANS, wrong], "edge") is None
    assert closing([SYM], "edge") is None
