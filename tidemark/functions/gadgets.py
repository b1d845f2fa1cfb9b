"""Boolean constraints over lists of literal columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(literals: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, literals, F.lit(True))


def any_of(literals: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, literals, F.lit(False))


def not_all(literals: Sequence[Column]) -> Column:
    """Blocks the state in which all hold; of no literals, every state."""
    return ~all_of(literals)


def how_many(literals: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b.cast("int"), literals, F.lit(0))


def at_least_one(literals: Sequence[Column]) -> Column:
    return any_of(literals)


def at_most_one(literals: Sequence[Column]) -> Column:
    return how_many(literals) <= 1


def exactly_one(literals: Sequence[Column]) -> Column:
    return how_many(literals) == 1


def stands_for_all(output: Column, literals: Sequence[Column]) -> Column:
    """``output`` has the truth value of the conjunction."""
    return output == all_of(literals)


def stands_for_either(output: Column, a: Column, b: Column) -> Column:
    return output == (a | b)
