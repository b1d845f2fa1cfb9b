"""Numbers for values, under which the values of connected pairs lie side by side.

Words of 64 values pay only if the values of a word belong together. Keys need not be like that: where keys of many unconnected parts
are interleaved, a word holds one value of each. So each value gets a number, in the order of the part of the graph it is found in:
every value points to its least neighbour, if that is less than itself, and pointers are followed. That takes one pass over the pairs.
Any numbers give the same set of pairs; good ones only make fewer words. Values that come later are numbered after the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

VALUE, NUMBER = "_value", "_number"
NUMBER_FROM = 4096  # values; fewer are in 64 words or some more at any rate
LEAST_GAIN = 2.0  # words of the values of each part as they are for each of their numbers, counted; below it values are not numbered
JUMPS = 6  # times that pointers are doubled, at most
BROADCAST_UP_TO = 500_000  # values; beyond it tables are joined by a shuffle


def _parts(pairs: DataFrame) -> DataFrame:
    """(VALUE, _part) of each value of either column, stored."""
    a, b = pairs.columns
    ends = pairs.select(F.expr(f"stack(2, `{a}`, `{b}`, `{b}`, `{a}`) as ({VALUE}, _near)"))
    found = cut(ends.groupBy(VALUE).agg(F.min("_near").alias("_near")).select(VALUE, F.least(VALUE, "_near").alias("_part")))
    for _ in range(JUMPS):
        to = found.select(F.col(VALUE).alias("_part"), F.col("_part").alias("_next"))
        further = cut(found.join(to, "_part").select(VALUE, F.col("_next").alias("_part"), (F.col("_next") < F.col("_part")).alias("_moved")))
        found, moved = further.drop("_moved"), further.where("_moved").isEmpty()
        if moved:
            break
    return found


def _numbered(parts: DataFrame, start: int) -> DataFrame:
    """(VALUE, NUMBER), stored: by range, then counted on in each partition, so no task has all values."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = parts.repartitionByRange(n, "_part", VALUE).sortWithinPartitions("_part", VALUE)
    return cut(ranged.select(VALUE, (F.monotonically_increasing_id() + F.lit(start)).alias(NUMBER)))


class Numbers:
    """The table of numbers. It only grows, so words made under it stay right."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        self.rows, top = table.agg(F.count(F.lit(1)), F.max(NUMBER)).first()
        self.next = (top or 0) // 64 * 64 + 64

    @classmethod
    def of(cls, pairs: DataFrame) -> Numbers | None:
        """For the values of these pairs, or None if they are few or lie well as they are."""
        parts = _parts(pairs)
        each = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.shiftright(VALUE, 6)).alias("words"))
        values, words, least = each.agg(F.sum("n"), F.sum("words"), F.sum(F.ceil(F.col("n") / 64))).first()
        if (values or 0) < NUMBER_FROM or words < LEAST_GAIN * least:
            return None
        return cls(_numbered(parts, 0))

    def cover(self, pairs: DataFrame) -> None:
        """Number those values of the pairs that have no number yet."""
        missing = cut(_parts(pairs).join(self.table, VALUE, "left_anti"))
        if not missing.isEmpty():
            more = Numbers(_numbered(missing, self.next))
            self.table, self.rows, self.next = cut(self.table.union(more.table)), self.rows + more.rows, more.next

    def _swapped(self, df: DataFrame, column: str, of: str, to: str) -> DataFrame:
        table = self.table.select(F.col(of).alias(column), F.col(to).alias("_as"))
        found = df.join(F.broadcast(table) if self.rows <= BROADCAST_UP_TO else table, column)
        return found.select(*[F.col("_as").alias(c) if c == column else F.col(c) for c in df.columns])

    def encode(self, df: DataFrame, *columns: str) -> DataFrame:
        """Numbers in place of values, all of which must be covered."""
        for c in columns:
            df = self._swapped(df, c, VALUE, NUMBER)
        return df

    def decode(self, df: DataFrame, *columns: str) -> DataFrame:
        """Values in place of numbers."""
        for c in columns:
            df = self._swapped(df, c, NUMBER, VALUE)
        return df
