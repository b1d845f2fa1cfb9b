"""Joins whose outputs are packed 64 at a time give what the plain join gives."""

import random

import pytest

from tests.test_saturation_and_epochs import naive, rows
from tidemark.functions.terms import Atom, Body, rule, search, variables
from tidemark.operators import packed as module
from tidemark.operators.candidates import candidates
from tidemark.operators.packed import packed
from tidemark.operators.relation import Relation
from tidemark.operators.saturate import saturate

w, x, y, z = variables("w x y z")
RULES = [
    rule(Atom("edge", x, z), Atom("edge", x, y), Atom("edge", y, z)),
    rule(Atom("back", z, x), Atom("wide", x, y, w), Atom("edge", y, z)),
    rule([Atom("from", x), Atom("both", x, z, x)], Atom("edge", x, y), Atom("wide", y, z, 2)),
    rule(Atom("loop", z), Atom("wide", y, y, z), Atom("edge", y, x)),
    rule(Atom("kept", x, y, z), Atom("wide", x, y, w), Atom("wide", y, w, z)),
]


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(module, "PROBE_FROM", 0)
    monkeypatch.setattr(module, "LEAST_GAIN", 0)


@pytest.mark.parametrize("seed", range(2))
def test_random_rules(spark, always, seed):
    rng = random.Random(seed)
    ids = [-(2**63), -65, -64, -1, 0, 1, 2, 63, 64, 127, 128, 2**63 - 1]
    inputs = {"edge": [(rng.choice(ids), rng.choice(ids)) for _ in range(14)], "wide": [tuple(rng.choice(ids) for _ in range(3)) for _ in range(40)]}
    want = naive(RULES, inputs)
    found = saturate(spark, RULES, {p: Relation.literal(spark, len(r[0]), r) for p, r in inputs.items()})
    for name in want:
        assert rows(found[name]) == sorted(want[name]), name


def test_every_bit_and_text_keys(spark, always):
    pairs = Relation.literal(spark, 2, [(i, "m") for i in range(-70, 3)]).counted()
    names = Relation.literal(spark, 2, [("m", i) for i in range(-130, 130)] + [("n", 1)]).counted()
    found = packed(Body([x, z], [Atom("p", x, y), Atom("n", y, z)]), [Atom("h", z, x)], {"p": pairs, "n": names})
    assert rows(found) == sorted((a, b) for a in range(-70, 3) for b in range(-130, 130))
    texts = Relation.literal(spark, 2, [("a", "b"), ("b", "c")]).counted()
    assert packed(Body([x, z], [Atom("p", x, y), Atom("p", y, z)]), [Atom("h", x, z)], {"p": texts}) is None


def test_when_the_plain_join_is_used(spark, monkeypatch):
    body, head = Body([x, z], [Atom("p", x, y), Atom("p", y, z)]), [Atom("h", x, z)]
    sparse = Relation.literal(spark, 2, [(i, 1000 * i) for i in range(50)])
    assert packed(body, head, {"p": sparse}) is None  # not counted
    assert packed(body, head, {"p": sparse.counted()}) is None  # small
    monkeypatch.setattr(module, "PROBE_FROM", 0)
    assert packed(body, head, {"p": sparse.counted()}) is None  # nothing to gain
    dense = Relation.literal(spark, 2, [(i, j) for i in range(20) for j in range(20)]).counted()
    assert len(rows(packed(body, head, {"p": dense}))) == 400
    assert packed(Body([x, y, z], body.atoms), [Atom("h", x, y, z)], {"p": dense}) is None  # the join variable stays
    assert packed(Body([x, y, z], [Atom("p", x, y), Atom("p", z, z)]), [Atom("h", x, z)], {"p": dense}) is None  # no join variable


def test_alternatives_of_a_search(spark, always):
    rng = random.Random(5)
    edges = sorted({(rng.randint(-3, 9), rng.randint(-3, 9)) for _ in range(40)})
    s = search(Body([x, z], [Atom("edge", x, z)]), [Atom("edge", x, y), Atom("edge", y, z)], [Atom("edge", z, z)])
    facts = {"edge": Relation.literal(spark, 2, edges)}
    want = [(a, c) for a, c in edges if (c, c) not in edges and not any(p == a and (q, c) in edges for p, q in edges)]
    assert want and rows(candidates(spark, [s], facts)[s]) == want
    assert rows(candidates(spark, [s], {"edge": facts["edge"].counted()})[s]) == want
