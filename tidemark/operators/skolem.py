"""Fresh ids for existential variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.terms import Var
from tidemark.operators.relation import Relation
from tidemark.session import cut, keep


def skolemize(captures: Relation, fresh: Sequence[Var], start: int) -> Relation:
    """Captures, as a set, with a new id for each variable in ``fresh``: start, start + 1, ... in the order of the captures,
    then of the variables. The same captures always get the same ids.

    Rows are range-partitioned and ranked within their partitions; the number of rows before each partition is added. Only one
    row per partition is ordered in one place."""
    names, given = captures.columns, tuple(captures.shape)
    rows = keep(captures.distinct().df)  # the ranges are found in a pass of their own
    ranged = cut(rows.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = ranged.join(F.broadcast(before), "_part")  # one row for each partition
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    ids = [(F.lit(start) + F.col("_rank") * len(fresh) + i).cast("long").alias(v.column) for i, v in enumerate(fresh)]
    return Relation((*given, *fresh), ranked.withColumn("_rank", rank).select(*[n for n in names if given], *ids))
