"""Relations: DataFrames with a known shape.

Facts have columns ``_0`` .. ``_{n-1}``, captures a column for each variable. A relation without columns keeps the marker
``_u``. Multiplicity is the number of rows, or, if the relation is signed, the sum of the hidden column ``_w``.

A set of pairs of numbers may be kept as ``words``: one column as it is, the values of the other 64 at a time, as the bits of
``_bits``. ``df`` is then made from these when it is asked for, and takes no room of its own. With ``numbers`` the words hold numbers in
place of values; without words, ``numbers`` say that all values have one there."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.terms import RuleError, Var
from tidemark.operators.numbers import Numbers
from tidemark.session import cut, keep

MARK, WEIGHT, WORD, BITS = "_u", "_w", "_word", "_bits"
Shape = int | tuple[Var, ...]


def columns_of(shape: Shape) -> list[str]:
    names = [f"_{i}" for i in range(shape)] if isinstance(shape, int) else [v.column for v in shape]
    return names or [MARK]


def word_of(name: str):
    return F.shiftright(name, 6)


def bit_of(name: str):
    return F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")


def merged(words: DataFrame) -> DataFrame:
    """One row for each word; all columns but the last two are its key."""
    return words.groupBy(*words.columns[:-1]).agg(F.bit_or(BITS).alias(BITS))


def pack(df: DataFrame, own: str) -> DataFrame:
    """The rows as a set, with the values of ``own`` 64 at a time."""
    return merged(df.select(*[c for c in df.columns if c != own], word_of(own).alias(WORD), bit_of(own).alias(BITS)))


def unpack(words: DataFrame, own: str, columns: Sequence[str]) -> DataFrame:
    """The rows that the words stand for."""
    bits = words.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr(f"shiftrightunsigned({BITS}, _at) & 1 = 1"))
    return bits.select(*[F.expr(f"shiftleft({WORD}, 6) | cast(_at as bigint)").alias(own) if c == own else F.col(c) for c in columns])


def turned(words: DataFrame, own: str) -> DataFrame:
    """The same pairs with the other column packed. Squares of 64 by 64 meet in one task first, so that few words are shuffled."""
    plain = words.columns[0]
    near = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), word_of(plain), F.col(WORD))
    return pack(unpack(near, own, [own, plain]), plain)


@dataclass(frozen=True)
class Relation:
    shape: Shape
    df: DataFrame
    rows: int | None = None  # how many, where that was counted, or more
    words: DataFrame | None = None  # the column kept as it is, WORD, BITS
    numbers: Numbers | None = None
    sole: bool = False  # each word has one row

    @classmethod
    def of_words(cls, shape: Shape, words: DataFrame, rows: int | None = None, numbers: Numbers | None = None, sole: bool = False) -> Relation:
        names, plain = columns_of(shape), words.columns[0]
        own = names[1 - names.index(plain)]
        if numbers is None:
            return cls(shape, unpack(words, own, names), rows, words, None, sole)
        return cls(shape, numbers.decode(unpack(numbers.decode(words, plain), own, names), own), rows, words, numbers, sole)

    @property
    def own(self) -> str:
        """The packed column."""
        return self.columns[1 - self.columns.index(self.words.columns[0])]

    def words_by(self, plain: str) -> DataFrame:
        """Words with this column as it is."""
        return self.words if self.words.columns[0] == plain else turned(self.words, self.own)

    def words_in(self, numbers: Numbers | None, plain: str) -> DataFrame:
        """Words under these numbers, with this column as it is; of pairs that are not kept so, too."""
        if self.words is not None and self.numbers is numbers:
            return self.words_by(plain)
        pairs, own = self.df.select(*self.columns), self.columns[1 - self.columns.index(plain)]
        if numbers is not None:
            if self.numbers is not numbers:
                numbers.cover(pairs)
            pairs = numbers.encode(pairs, *pairs.columns)
        return pack(pairs, own)

    @property
    def packable(self) -> bool:
        return self.shape == 2 and not self.signed and all(isinstance(k, T.LongType) for k in self.kinds)

    def packed(self, numbers: Numbers | None = None) -> Relation:
        """The facts as a set, as stored words, if they are pairs of numbers; else as they are, stored. Counted. Without ``numbers``,
        values are numbered if that pays."""
        if not self.packable:
            return self.distinct().stored().counted()
        held, numbers = self, numbers or self.numbers
        if numbers is None and self.words is None:
            held = self.with_df(keep(self.df.select("_0", "_1")))
            numbers = Numbers.of(held.df)
            held = replace(held, numbers=numbers)
        return Relation.of_words(2, held.words_in(numbers, "_0"), numbers=numbers).stored().counted()

    @property
    def columns(self) -> list[str]:
        return columns_of(self.shape)

    @property
    def signed(self) -> bool:
        return WEIGHT in self.df.columns

    @classmethod
    def facts(cls, df: DataFrame, signed: bool = False) -> Relation:
        """The columns of ``df`` in their order, ids as long; with ``signed`` the last one is the multiplicity. Rows with a null
        are left out: facts have none."""
        names = df.columns[:-1] if signed else df.columns
        wide = {"byte", "short", "integer", "tinyint", "smallint", "int"}
        cols = [F.col(f"`{c}`").cast("long") if df.schema[c].dataType.typeName() in wide else F.col(f"`{c}`") for c in names]
        out = df.select(*[c.alias(f"_{i}") for i, c in enumerate(cols)], *([F.col(f"`{df.columns[-1]}`").cast("long").alias(WEIGHT)] if signed else []))
        for i in range(len(names)):
            out = out.where(F.col(f"_{i}").isNotNull())
        return cls(len(names), out if names else out.select(F.lit(1).cast("long").alias(MARK), *([WEIGHT] if signed else [])))

    @classmethod
    def literal(cls, spark: SparkSession, arity: int, rows: Iterable[Sequence], signed: bool = False, kinds: Sequence[T.DataType] | None = None) -> Relation:
        """In-memory facts; a signed row ends with its multiplicity. ``kinds``: column types, taken from the first row if not given."""
        rows = [tuple(r) for r in rows]
        kinds = list(kinds) if kinds is not None else [T.StringType() if rows and isinstance(rows[0][i], str) else T.LongType() for i in range(arity)]
        fields = [T.StructField(f"_{i}", k) for i, k in enumerate(kinds)] or [T.StructField(MARK, T.LongType())]
        data = [((1, *r) if not arity else r) for r in rows]
        return cls(arity, spark.createDataFrame(data, T.StructType(fields + [T.StructField(WEIGHT, T.LongType())] * signed)))

    @classmethod
    def empty(cls, spark: SparkSession, arity: int, kinds: Sequence[T.DataType] | None = None) -> Relation:
        return cls.literal(spark, arity, [], kinds=kinds)

    @property
    def kinds(self) -> list[T.DataType]:
        return [self.df.schema[c].dataType for c in columns_of(self.shape)] if self.shape else []

    def with_df(self, df: DataFrame) -> Relation:
        return Relation(self.shape, df)

    def weighted(self) -> Relation:
        return self if self.signed else self.with_df(self.df.withColumn(WEIGHT, F.lit(1).cast("long")))

    def consolidated(self) -> Relation:
        """One row per tuple with its summed multiplicity; tuples that sum to zero are gone, negative ones stay."""
        return self.with_df(self.weighted().df.groupBy(*self.columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0))

    def distinct(self) -> Relation:
        """The set of tuples whose multiplicity is positive."""
        if self.words is not None:
            return Relation.of_words(self.shape, merged(self.words), numbers=self.numbers)
        if not self.signed:
            return self.with_df(self.df.select(*self.columns).distinct())
        return self.with_df(self.consolidated().df.where(F.col(WEIGHT) > 0).select(*self.columns))

    def minus(self, other: Relation) -> Relation:
        """Tuples of this one that are not in the other, both taken as given."""
        if self.words is not None and other.words is not None:
            mine, theirs = self.words, other.words_in(self.numbers, other.columns[self.columns.index(self.words.columns[0])])
            plain, zero = mine.columns[0], F.lit(0).cast("long")
            both = mine.select(plain, WORD, BITS, zero.alias("_not")).union(theirs.select(theirs.columns[0], WORD, zero, BITS))
            sums = both.groupBy(plain, WORD).agg(F.bit_or(BITS).alias(BITS), F.bit_or("_not").alias("_not"))
            return Relation.of_words(self.shape, sums.select(plain, WORD, F.expr(f"{BITS} & ~_not").alias(BITS)).where(F.col(BITS) != 0), numbers=self.numbers)
        return self.with_df(self.df.join(other.df.select(*other.columns), self.columns, "left_anti").select(*self.df.columns))

    def stored(self) -> Relation:
        if self.words is not None:
            return Relation.of_words(self.shape, keep(self.words), self.rows, self.numbers, self.sole)
        return Relation(self.shape, keep(self.df) if self.packable else cut(self.df), self.rows, numbers=self.numbers)

    def stored_sums(self) -> Relation:
        """One row per tuple with its summed multiplicity, stored; pairs of numbers as words of pairs with one sum."""
        sums = self.consolidated()
        if sums.shape != 2 or not all(isinstance(k, T.LongType) for k in sums.kinds):
            return sums.stored()
        return sums.with_df(unpack(keep(pack(sums.df, "_1")), "_1", sums.df.columns))

    def counted(self) -> Relation:
        if self.words is not None:
            return Relation(self.shape, self.df, self.words.agg(F.sum(F.bit_count(BITS))).first()[0] or 0, self.words, self.numbers, self.sole)
        return Relation(self.shape, self.df, self.df.count(), numbers=self.numbers)

    def named(self, *names: str) -> DataFrame:
        """The tuples under other column names."""
        return self.df.select(*[F.col(c).alias(n) for c, n in zip(self.columns, names or [v.name for v in self.shape], strict=True)])


def concat(relations: Sequence[Relation]) -> Relation:
    """Multiset union of relations of one shape."""
    first = relations[0]
    if any(r.shape != first.shape for r in relations):
        raise RuleError("relations of different shapes cannot be put together")
    if any(r.signed for r in relations):
        relations = [r.weighted() for r in relations]
    keep = first.columns + [WEIGHT] * any(r.signed for r in relations)
    rows = None if any(r.rows is None for r in relations) else sum(r.rows for r in relations)
    if len(relations) == 1:
        return Relation(first.shape, first.df.select(*keep), rows, first.words, first.numbers)
    numbers = first.numbers if all(r.numbers is first.numbers for r in relations) else None
    if first.words is not None and all(r.words is not None and r.words.columns == first.words.columns and r.numbers is first.numbers for r in relations):
        return Relation.of_words(first.shape, reduce(DataFrame.union, [r.words for r in relations]), rows, numbers)
    return Relation(first.shape, reduce(DataFrame.unionByName, [r.df.select(*keep) for r in relations]), rows, numbers=numbers)


def spread(facts: Mapping[str, Relation]) -> dict[str, list[float]]:
    """For each predicate its number of rows, then about how many values each column has: one pass over each."""
    found = {}
    for name, r in facts.items():
        row = r.df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in r.columns if c != MARK]).first()
        found[name] = [float(max(n, 1)) for n in row]
    return found
