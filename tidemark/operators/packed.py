"""Joins of two atoms whose join variables are dropped, with the values of one output column 64 at a time.

Such a join, as in path(x, z) from path(x, y) and path(y, z), makes each pair once for every y in between, only for the next distinct
to drop the repeats. Here the z of each y are put into words of 64 bits first, so one joined row stands for up to 64, and words are
merged with ``bit_or`` before and after the shuffle. The result is the same set.

If both relations are kept as words, their pairs are not made at all: a word of y's meets the words of z's of these 64 y."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.terms import Atom, Body, Var, vars_of
from tidemark.operators.blocks import product
from tidemark.operators.lower import match
from tidemark.operators.relation import BITS, WORD, Relation, bit_of, merged, unpack, word_of

PROBE_FROM = 10**9  # product of both sides' rows, which bounds the joined rows; below it the plain join is quick
LEAST_GAIN = 4  # joined rows for each joined word, counted; below it the plain join is used
MOST_MISSES = 16  # tried words for each joined one; above it the y are taken one by one
BLOCKS_FROM = 10**8  # joined rows; fewer are not worth blocks
BLOCK_WORDS = 12  # words put together in blocks that take the time of one joined word


def _split(a: Atom, b: Atom, kinds: list[T.DataType], wanted: set[Var]) -> tuple[list[Var], Var] | None:
    """The join variables and the variable of ``b`` to be packed, if this order fits."""
    shared = [v for v in a.vars if v in b.vars]
    own = [v for v in b.vars if v in wanted and v not in shared]
    if len(own) != 1 or not set(shared) - wanted or not isinstance(kinds[b.terms.index(own[0])], T.LongType):
        return None
    return shared, own[0]


def chained(body: Body, wanted: set[Var]) -> Var | None:
    """The one join variable, if the body is two atoms of two variables each, of which the other two are wanted."""
    atoms = body.atoms
    if len(atoms) != 2 or any(a.arity != 2 or len(a.vars) != 2 for a in atoms):
        return None
    shared = [v for v in atoms[0].vars if v in atoms[1].vars]
    return shared[0] if len(shared) == 1 and wanted == {v for a in atoms for v in a.vars} - {*shared} else None


def _of_words(body: Body, y: Var, sources: Mapping[str, Relation], only: Relation | None = None) -> Relation | None:
    """The join of two relations kept as words. How many rows and words it joins is judged by the sums for each 64 join values."""
    a, b = sorted(body.atoms, key=lambda a: a.terms[0] == y)  # rather the y packed on the left, plain on the right
    (x,), (z,) = ([v for v in side.vars if v != y] for side in (a, b))
    held = [match(sources[side.predicate], side) for side in (a, b)]
    numbers = held[0].numbers or held[1].numbers
    left, right = held[0].words_in(numbers, x.column), held[1].words_in(numbers, y.column)
    left = left.select(x.column, F.col(WORD).alias("_of"), F.col(BITS).alias("_has"))
    right = right.select(word_of(y.column).alias("_of"), bit_of(y.column).alias("_is"), WORD, BITS)
    per = lambda df, bits, n, m: df.groupBy("_of").agg(F.count(F.lit(1)).cast("double").alias(n), F.sum(F.bit_count(bits)).cast("double").alias(m))
    sums = per(left, "_has", "ln", "lm").join(per(right, BITS, "rn", "rm"), "_of")
    tried, joined, rows = sums.agg(F.sum(F.expr("ln * rn")), F.sum(F.expr("lm * rn / 64")), F.sum(F.expr("lm * rm / 64"))).first()
    if not rows:
        return None
    if rows >= BLOCKS_FROM:
        n, m = (df.agg(F.sum(F.bit_count(bits))).first()[0] for df, bits in ((left, "_has"), (right, BITS)))
        if n * right.select(WORD).distinct().count() < BLOCK_WORDS * joined:
            mask = only.words_in(numbers, x.column) if only is not None and only.words is not None and set(only.shape) == {x, z} else None
            found = product(left, held[1].words_in(numbers, y.column), (n, m), mask)
            return Relation.of_words(tuple(sorted([x, z])), found, numbers=numbers, sole=True)
    if rows < LEAST_GAIN * joined:
        return None
    if tried > MOST_MISSES * joined:
        pairs = unpack(left.select(x.column, F.col("_of").alias(WORD), F.col("_has").alias(BITS)), y.column, [x.column, y.column])
        found = pairs.select(x.column, word_of(y.column).alias("_of"), bit_of(y.column).alias("_is")).join(right, ["_of", "_is"])
    else:
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = left.repartition(n, "_of").join(right.repartition(n, "_of"), "_of").where("(_has & _is) <> 0")
    return Relation.of_words(tuple(sorted([x, z])), merged(found.select(x.column, WORD, BITS)), numbers=numbers)


def packed(body: Body, heads: Iterable[Atom], sources: Mapping[str, Relation], only: Relation | None = None) -> Relation | None:
    """The distinct captures of all variables of the heads, or None if the plain join is to be used. Those that ``only``, captures of the same
    variables, does not hold may be left out."""
    wanted = set(vars_of(heads))
    if len(body.atoms) != 2:
        return None
    sides = [(a, sources[a.predicate]) for a in body.atoms]
    if any(r.rows is None or r.signed for _, r in sides) or sides[0][1].rows * sides[1][1].rows < PROBE_FROM:
        return None
    if (y := chained(body, wanted)) and all(r.words is not None for _, r in sides):
        return _of_words(body, y, sources, only)
    sides.sort(key=lambda s: s[1].rows)  # the larger one is packed, if it can be
    for (a, left), (b, right) in (sides, sides[::-1]):
        if found := _split(a, b, right.kinds, wanted):
            break
    else:
        return None
    shared, own = found
    key, z = [v.column for v in shared], own.column
    kept = [v for v in a.vars if v in wanted]
    pairs = match(left, a).df.select(*dict.fromkeys([*(v.column for v in kept), *key]))
    each = match(right, b).df.select(*key, F.shiftright(z, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(`{z}` & 63 as int))").alias("_bit"))
    words = each.groupBy(*key, "_word").agg(F.bit_or("_bit").alias("_bits"))
    sizes = each.groupBy(*key, "_word").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    counted = pairs.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("times")).join(sizes, key)
    rows, joined = counted.agg(F.sum(F.col("times") * F.col("n")), F.sum(F.col("times") * F.col("words"))).first()
    if not rows or rows < LEAST_GAIN * joined:
        return None
    group = [v.column for v in kept]
    merged = pairs.join(words, key).groupBy(*group, "_word").agg(F.bit_or("_bits").alias("_bits"))
    bits = merged.select(*group, "_word", "_bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_at"))
    bits = bits.where(F.expr("shiftrightunsigned(_bits, _at) & 1 = 1"))
    shape = tuple(sorted([*kept, own]))
    value = F.expr("shiftleft(_word, 6) | cast(_at as bigint)")
    return Relation(shape, bits.select(*[value.alias(z) if v == own else F.col(v.column) for v in shape]))
