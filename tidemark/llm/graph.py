"""Connected components of a links table by large-star and small-star contraction.

Each round makes every node point at the smallest node it knows; rounds end when nothing changes, after about log(n) of
them. Nothing is collected but one count and checksum a round. Each round is stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in a link; the component is its smallest node. Loops and repeats do no harm."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        # large star: each node's larger neighbours go to its smallest one. Nodes without a smaller neighbour, such as the
        # centres of stars, keep theirs. The lookup is stored first, so that the join can split the rows of a hot centre.
        lowest = cut(edges.groupBy("u").agg(F.min("v").alias("m"))).withColumnRenamed("u", "at")
        large = cut(edges.join(lowest, F.col("v") == F.col("at"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # small star: each node's smaller neighbours go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u > v").distinct())
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
