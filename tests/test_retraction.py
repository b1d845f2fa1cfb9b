"""Removals: what falls, what comes back, and what an epoch says it changed, against naive evaluation from scratch."""

import random

import pytest

from tests.test_saturation_and_epochs import naive, rows
from tidemark.functions.terms import Atom, rule, variables
from tidemark.operators import saturate
from tidemark.streaming import session as sessions
from tidemark.streaming.session import Deduction

x, y, z = variables("x y z")
PATHS = [rule(Atom("path", x, y), Atom("edge", x, y)), rule(Atom("path", x, z), Atom("path", x, y), Atom("edge", y, z))]
LOOPS = [rule(Atom("loop"), Atom("path", x, x)), rule(Atom("start", x), Atom("path", x, 3)), rule([Atom("path", x, x), Atom("seen", x)], Atom("start", x), Atom("loop"))]
TRANS = [rule(Atom("edge", x, z), Atom("edge", x, y), Atom("edge", y, z))]


@pytest.mark.parametrize(("rules", "share", "seed"), [(PATHS, 2.0, 1), (PATHS + LOOPS, 2.0, 2), (PATHS + LOOPS, 0.5, 3), (TRANS, 2.0, 4), (PATHS + LOOPS, 0.0, 5)])
def test_removals_over_epochs(spark, monkeypatch, rules, share, seed):
    """The share decides only how an epoch is computed: 2 always derives again what fell, 0 always starts anew."""
    monkeypatch.setattr(saturate, "REDERIVE_UP_TO", share)
    monkeypatch.setattr(sessions, "STORE_EVERY", 2)
    rng, held = random.Random(seed), {}
    session = Deduction(spark, rules)
    before = None
    for epoch in range(4):
        add = [(rng.randint(0, 7), rng.randint(0, 7)) for _ in range(9 if epoch == 0 else 1)]
        drop = [] if epoch == 0 else rng.sample(sorted(f for f, k in held.items() if k > 0), 2)
        for f, k in [*((f, 1) for f in add), *((f, -1) for f in drop)]:
            held[f] = held.get(f, 0) + k
        session.insert("edge", add)
        if drop:
            session.remove("edge", drop)
        session.advance(epoch)
        want = naive(rules, {"edge": {f for f, k in held.items() if k > 0}})
        for name in want:
            got = rows(session.facts(name))
            assert [r if name != "loop" else () for r in got] == sorted(want[name]), (epoch, name)
            if before is not None and name != "loop":
                change = [(*f, 1) for f in want[name] - before[name]] + [(*f, -1) for f in before[name] - want[name]]
                assert rows(session.changes(name)) == sorted(change), (epoch, name)
        before = want


def test_a_fact_that_is_inserted_and_derived_stays(spark, monkeypatch):
    monkeypatch.setattr(saturate, "REDERIVE_UP_TO", 2.0)
    session = Deduction(spark, PATHS)
    session.insert("edge", [(1, 2), (2, 3)])
    session.insert("path", [(1, 3), (1, 2)])
    session.advance(1)
    session.remove("edge", [(1, 2)])
    session.advance(2)
    assert rows(session.facts("path")) == [(1, 2), (1, 3), (2, 3)]
    session.remove("path", [(1, 2)])
    session.advance(3)
    # (1, 3) is inserted still
    assert rows(session.facts("path")) == [(1, 3), (2, 3)]
    assert rows(session.changes("path")) == [(1, 2, -1)]


def test_more_removed_than_inserted(spark):
    session = Deduction(spark, PATHS)
    session.remove("edge", [(1, 2)])
    session.advance(1)
    assert rows(session.facts("path")) == []
    session.insert("edge", [(1, 2)])
    session.advance(2)
    assert rows(session.facts("path")) == []
    session.insert("edge", [(1, 2)])
    session.advance(3)
    assert rows(session.facts("path")) == [(1, 2)]
