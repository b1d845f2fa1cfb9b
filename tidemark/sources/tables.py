"""Predicates read from Parquet tables. Keys are cast to long; scans read only the columns that a predicate needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.relation import Relation

KEYS = {
    "region": ("region", "r_regionkey"),
    "nation": ("nation", "n_nationkey"),
    "part": ("part", "p_partkey"),
    "supplier": ("supplier", "s_suppkey"),
    "customer": ("customer", "c_custkey"),
    "in_region": ("nation", "n_nationkey", "n_regionkey"),
    "cust_nation": ("customer", "c_custkey", "c_nationkey"),
    "supp_nation": ("supplier", "s_suppkey", "s_nationkey"),
    "placed": ("orders", "o_custkey", "o_orderkey"),
    "item": ("lineitem", "l_orderkey", "l_partkey", "l_suppkey"),
}


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, predicate: str) -> Relation:
        name, *keys = KEYS[predicate]
        return Relation.facts(self.raw(name).select(*keys))

    def all(self, *predicates: str) -> dict[str, Relation]:
        return {p: self[p] for p in predicates}

    def with_priority(self, priority: str) -> Relation:
        return Relation.facts(self.raw("orders").where(F.col("o_orderpriority") == priority).select("o_orderkey"))

    def hop_bag(self, below: int | None = None) -> Relation:
        """Suppliers of neighbouring lines of an order, with repeats; only orders below the key, if one is given. The lines of an
        order meet once, sorted, so they are shuffled once and not for each side of a join."""
        lines = self.raw("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey")
        lines = lines.where("l_orderkey is not null and l_linenumber is not null and l_suppkey is not null")
        lines = lines if below is None else lines.where(F.col("l_orderkey") < below)
        after = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
        return Relation.facts(lines.select("l_suppkey", F.collect_set("l_suppkey").over(after).alias("b")).select("l_suppkey", F.explode("b").alias("b")))

    def hop(self, below: int | None = None) -> Relation:
        """The same as a set."""
        return self.hop_bag(below).distinct()
