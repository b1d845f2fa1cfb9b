"""The local search ends only where no step is left, wherever the partner and the pair lie."""

import random

import pytest

from tidemark.llm import packing


def step_left(bins, lengths, capacity):
    """A step by brute force: one or two documents of a bin for none or one of a bin at least as full, so that it becomes fuller."""
    parts = [[lengths[i] for i in b] for b in bins]
    for a in parts:
        gives = {n for n in a} | {n + m for k, n in enumerate(a) for m in a[k + 1 :]}
        for b in parts:
            room = capacity - sum(b)
            if b is not a and sum(a) <= sum(b) < capacity and any(0 < g - t <= room for g in gives for t in (0, *b)):
                return a, b
    return None


def checked(start, lengths, capacity):
    done = packing.improve(start, lengths, capacity)
    assert sorted(i for b in done for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in done)
    assert step_left(done, lengths, capacity) is None
    return done


def test_a_partner_behind_64_fuller_bins():
    """The last document fits only in the bin with most room; 80 others are fuller."""
    assert len(checked([[i] for i in range(80)] + [[80], [81]], [99] * 80 + [50, 40], 100)) == 81


def test_a_pair_behind_the_12_smallest():
    """Only the 13th and the 14th document together are longer than one of the fuller bin, and by its room."""
    lengths = [2] * 12 + [30, 33] + [62, 100 + 35]
    checked([list(range(14)), [14, 15]], lengths, 198)
    assert step_left([list(range(14)), [14, 15]], lengths, 198)


@pytest.mark.parametrize("seed", range(3))
def test_no_step_is_left(seed):
    rng = random.Random(seed)
    for lengths, capacity in (([rng.randint(500, 1100) for _ in range(600)], 2048), ([rng.randint(1, 40) for _ in range(80)], 100)):
        checked(packing.best_fit(lengths, capacity), lengths, capacity)
        order = rng.sample(range(len(lengths)), len(lengths))
        checked([[i] for i in order], lengths, capacity)
