"""Words pay also where keys of unconnected parts are interleaved: values are numbered by the part they are in."""

import random

import pytest

from tests.test_saturation_and_epochs import naive, rows
from tidemark.functions.terms import Atom, Body, rule, search, variables
from tidemark.operators import packed as module
from tidemark.operators.candidates import candidates
from tidemark.operators.relation import Relation
from tidemark.operators.saturate import saturate
from tidemark.streaming.session import Deduction

x, y, z = variables("x y z")
CHAIN = rule(Atom("hop", x, z), Atom("hop", x, y), Atom("hop", y, z))
ODD = [rule(Atom("odd", x, y), Atom("hop", x, y)), rule(Atom("even", x, z), Atom("odd", x, y), Atom("hop", y, z)), rule(Atom("odd", x, z), Atom("even", x, y), Atom("hop", y, z))]
COPIES, IDS = 64, [-(2**63), -65, -64, -1, 0, 1, 2, 63, 64, 127, 128, 2**63 - 1]


@pytest.fixture(params=[1, 500_000], ids=["shuffled", "broadcast"])
def numbered(request, monkeypatch):
    from tidemark.operators import numbers

    monkeypatch.setattr(module, "PROBE_FROM", 0)
    monkeypatch.setattr(module, "LEAST_GAIN", 0)
    monkeypatch.setattr(numbers, "NUMBER_FROM", 0)
    monkeypatch.setattr(numbers, "BROADCAST_UP_TO", request.param)
    return monkeypatch


@pytest.fixture
def always(numbered):
    from tidemark.operators import numbers

    numbered.setattr(numbers, "LEAST_GAIN", 0)


def apart(edges):
    """The same edges once for each copy, all keys interleaved."""
    return [(a * COPIES + c, b * COPIES + c) for a, b in edges for c in range(COPIES)]


def test_interleaved_keys_make_few_words(spark, numbered):
    edges = apart([(i, (i + d) % 20) for i in range(20) for d in (1, 2, 5, 7)])
    hop = Relation.literal(spark, 2, edges)
    assert hop.packed().words.count() < len(edges) / 2 and rows(hop.packed()) == sorted(edges)
    found = saturate(spark, [CHAIN], {"hop": hop})["hop"]
    assert rows(found) == sorted(apart([(a, b) for a in range(20) for b in range(20)]))
    assert found.words.count() < COPIES * 20 * 3  # 20 times as many are made of the keys as they are


def some(seed, n=14):
    rng = random.Random(seed)
    return [(rng.choice(IDS), rng.choice(IDS)) for _ in range(n)]


def test_rules_under_numbers(spark, always):
    edges = some(1, 9)
    rules = [CHAIN, *ODD, rule(Atom("hop", y, x), Atom("back", x, y)), rule(Atom("hop", x, 77), Atom("hop", x, x)), *[rule(Atom(f"goal{i}"), Atom("hop", 0, i)) for i in (1, 63)]]
    inputs = {"hop": edges, "back": some(2, 3) + [(5, 6)]}
    found, want = saturate(spark, rules, {p: Relation.literal(spark, 2, r) for p, r in inputs.items()}), naive(rules, inputs)
    assert all(found[p].numbers is not None and found[p].words is not None for p in ("hop", "odd", "even"))
    for p in want:
        assert rows(found[p]) == sorted(want[p]), p


def test_searches_under_numbers(spark, always):
    edges = some(9, 30)
    hop = Relation.literal(spark, 2, edges).packed()
    between, back = (search(Body([x, z], [Atom("hop", x, z)]), a) for a in ([Atom("hop", x, y), Atom("hop", y, z)], [Atom("hop", z, x)]))
    found = candidates(spark, [between, back], {"hop": hop})
    assert rows(found[between]) == sorted({(a, c) for a, c in edges if not any(p == a and (q, c) in edges for p, q in edges)})
    assert rows(found[back]) == sorted({(a, c) for a, c in edges if (c, a) not in edges})


def test_two_numberings_and_none(spark, always):
    a, b = some(3, 40), some(4, 40)
    left, right = (Relation.literal(spark, 2, r).packed() for r in (a, b))
    plain = Relation.of_words(2, right.words_in(None, "_1")).counted()
    assert left.numbers is not right.numbers and plain.numbers is None
    assert rows(left.minus(right)) == rows(left.minus(plain)) == sorted(set(a) - set(b)) and rows(plain.minus(left)) == sorted(set(b) - set(a))
    found = module.packed(Body([x, z], [Atom("p", x, y), Atom("q", y, z)]), [Atom("h", x, z)], {"p": left, "q": plain})
    assert rows(found) == sorted({(i, k) for i, j in a for m, k in b if j == m})


def test_epochs_number_new_values(spark, always):
    one, two = [(a, b) for a in range(4) for b in range(4, 8)] + [(5, 0)], [(100 + a, 100 + (a + 1) % 7) for a in range(7)]
    session = Deduction(spark, [CHAIN])
    session.insert("hop", one[:9] + two)
    session.advance(1)
    session.insert("hop", one[4:] + [(2**63 - 1, 5), (-(2**63), -1)])
    session.advance(2)
    edges = one + two + [(2**63 - 1, 5), (-(2**63), -1)]
    assert rows(session.facts("hop")) == sorted(naive([CHAIN], {"hop": edges})["hop"])
    session.remove("hop", [(5, 0), one[0], one[4], one[4]])
    session.insert("hop", [(7, 9000)])
    session.advance(3)
    left = [e for e in edges if e not in ((5, 0), one[0], one[4])] + [(7, 9000)]
    assert not session._anew and session.facts("hop").numbers is not None
    assert rows(session.facts("hop")) == sorted(naive([CHAIN], {"hop": left})["hop"])
