import random

import numpy as np
import pytest

from tidemark.functions.terms import Atom, Body, rule, search, variables
from tidemark.operators import blocks, packed
from tidemark.operators.candidates import candidates
from tidemark.operators.relation import Relation
from tidemark.operators.saturate import saturate
from tidemark.operators.skolem import skolemize

x, y, z = variables("x y z")


def pairs_of(seed, n, low=-3000, high=3000):
    rng = random.Random(seed)
    return sorted({(rng.randint(low, high), rng.randint(low, high)) for _ in range(n)} | {(5, 63), (63, 127), (63, -1), (-1, -64), (5, 5)})


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of some hundred pairs, also for few pairs."""
    for module, name, to in ((packed, "PROBE_FROM", 1), (packed, "BLOCKS_FROM", 1), (packed, "BLOCK_WORDS", 10**9), (blocks, "CELL", 900), (blocks, "DENSE_MB", 0.1), (blocks, "AT_ONCE", 3)):
        monkeypatch.setattr(module, name, to)


def two_steps(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    return {(a, c) for a, b in pairs for c in after.get(b, ())}


def test_pairs_are_read_as_written():
    rng = np.random.default_rng(1)
    for high in (1, 100, 2**20, 2**61):
        a, b = rng.integers(-high, high, 500), rng.integers(-high, high, 500)
        assert sorted(zip(*(v.tolist() for v in blocks._read(blocks._written(a, b))), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
    bits = np.array([-1, 1, -(2**63), 2**63 - 1], np.int64)
    a, b = blocks._pairs(np.arange(4), np.array([0, -1, 7, 2]), bits)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((i, w * 64 + k) for i, (w, v) in enumerate(((0, -1), (-1, 1), (7, -(2**63)), (2, 2**63 - 1))) for k in range(64) if v >> k & 1)


def test_sparse_pairs_are_chained_in_blocks(spark, small_blocks):
    pairs = pairs_of(1, 4000)
    held = {"hop": Relation.literal(spark, 2, pairs).packed()}
    body = Body([x, z], [Atom("hop", x, y), Atom("hop", y, z)])
    found = packed.packed(body, [Atom("two", x, z)], held)
    assert found is not None and found.sole
    rows = [tuple(r) for r in found.named().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == two_steps(pairs)
    only = Relation.literal(spark, 2, pairs[::2]).packed()
    only = Relation.of_words((x, z), only.words.withColumnRenamed("_0", x.column), only.rows)
    assert {tuple(r) for r in packed.packed(body, [Atom("two", x, z)], held, only).named().collect()} == two_steps(pairs) & set(pairs[::2])


def test_rules_and_searches_over_blocks(spark, small_blocks):
    pairs = pairs_of(2, 6000, 0, 1500)
    hop = Relation.literal(spark, 2, pairs)
    two = saturate(spark, [rule(Atom("two", x, z), Atom("hop", x, y), Atom("hop", y, z))], {"hop": hop})["two"]
    assert two.rows == len(two_steps(pairs)) and {tuple(r) for r in two.named("a", "b").collect()} == two_steps(pairs)
    s = search(Body([x, z], [Atom("hop", x, z)]), [Atom("hop", x, y), Atom("hop", y, z)])
    lacking = sorted(set(pairs) - two_steps(pairs))
    found = candidates(spark, [s], {"hop": hop.packed()})[s]
    assert lacking and sorted(map(tuple, found.named().collect())) == lacking
    fresh = skolemize(found, [y], 100).df.select(x.column, z.column, y.column).collect()
    assert sorted(map(tuple, fresh)) == [(a, b, 100 + i) for i, (a, b) in enumerate(lacking)]
