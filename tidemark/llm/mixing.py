"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is hashed into about sqrt(n) blocks of about sqrt(n) documents. Its target, in words, is turned into passes over
the source: whole passes take every block once, the last pass takes blocks in a permuted order until the target is
reached, and splits the block on the border by documents. So each source has an exact quota of blocks. A binary tree
over the output shards splits the vector of quotas: at each node the left half draws its share without replacement,
a multivariate-hypergeometric draw over the sources, until each shard has its own quota from each source. Shards then take
disjoint runs of the permuted blocks, and rows are shuffled inside their shard by a hash. All draws and permutations
are seeded, so reruns agree.

The driver holds two numbers per source and shard; documents and blocks stay distributed. Both windows sort at most
some sqrt(n) rows of a source in one task, also where one source holds most rows.

Sources are ordered by code point, null last; weights repeat in that order. A null text has size 0. Rows with equal id, text
and source are each counted and told apart by numbers, so they lie in different blocks and no group of copies is hot. An empty
table gives an empty result. Documents of a source without any words get target 0 and are not taken. Texts of any length are one
document. ``draw`` reads id, text and source only; ``mix`` hands on all columns, whatever their names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, word_count
from tidemark.session import cut

SEGMENTS = 64  # tasks a shard's rows are sorted in
CAP = 3.0  # no source gives more than so many times its words


def targets(sizes: list[int], weights: tuple[float, ...] = (1, 2, 3), cap: float = CAP) -> list[float]:
    """Words each source should give: shares of all words by weight, held at ``cap`` times the source's own; what is over is
    reshared among the others by weight until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in over)
    return out


def split_quotas(quotas: list[int], n_shards: int, seed: int = 0) -> np.ndarray:
    """Matrix shards x sources of block quotas: its columns add up to ``quotas``, its rows are as equal as can be."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(have.sum())
        left = total * (mid - lo) // (hi - lo)
        took, rest, need = np.zeros_like(have), total, left
        for i, n in enumerate(have):  # the multivariate draw, one source after the other
            rest -= int(n)
            took[i] = rng.hypergeometric(int(n), rest, need) if need and n else 0
            need -= int(took[i])
        split(lo, mid, took)
        split(mid, hi, have - took)

    split(0, n_shards, np.asarray(quotas, np.int64))
    return out


def _source_key():
    """Sources as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.hex(F.col("source").cast("string"))), F.lit("1"))


SAME = ("doc_id", "_key", "source")  # what equal rows have in common


def numbered(rows: DataFrame, same: tuple[str, ...] = SAME) -> DataFrame:
    """``rows`` with _copy: equal rows are numbered from 0. ``rows`` must be stored and have _row, made by monotonically_increasing_id.

    Rows are numbered inside their partition and the numbers before each partition are added, so no task has all copies."""
    part = F.shiftright("_row", 33).alias("_part")
    counts = rows.groupBy(*same, part).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*same).orderBy("_part"))
    before = counts.select(*[F.col(c).alias(f"_of_{c}") for c in same], F.col("_part").alias("_at"), (upto - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_part", part)
    equal = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in same]
    placed = placed.join(before, [*equal, F.col("_part") == F.col("_at")])
    inside = F.row_number().over(Window.partitionBy(*same, "_part").orderBy("_row"))
    return placed.withColumn("_copy", F.col("_before") + inside - 1).select(*rows.columns, "_copy")


def identified(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, _key, source, size, many, _copy) of each row, stored; ``many``: other rows are equal."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"), _source_key().alias("source"), word_count().alias("size"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # texts are read once
    groups = cut(rows.groupBy(*SAME).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_in_{c}") for c in SAME]))
    if groups.isEmpty():
        return rows.withColumns({"many": F.lit(False), "_copy": F.lit(0).cast("long")})
    equal = [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in SAME]
    single = rows.join(groups, equal, "left_anti").withColumns({"many": F.lit(False), "_copy": F.lit(0).cast("long")})
    many = numbered(cut(rows.join(groups, equal, "left_semi").drop("_row").withColumn("_row", F.monotonically_increasing_id()))).withColumn("many", F.lit(True))
    return cut(single.unionByName(many))


def draw(docs: DataFrame, n_shards: int = 8, weights: tuple[float, ...] = (1, 2, 3), cap: float = CAP, seed: int = 0, max_sources: int = 100_000, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, _key, source, _copy, many, size, source_size, target, copies, shards, place): how often each document is taken, and where
    to. ``source`` is the sources' sort key; ``_key`` tells rows with the same id apart by their texts, ``_copy`` equal rows.
    ``max_sources`` bounds what the driver holds: some 100 bytes a source and 8 a source and shard. ``rows``: ``identified(docs)``,
    if it is there already."""
    rows = identified(docs) if rows is None else rows
    per_source = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources: merge rare ones first")
    per_source.sort(key=lambda r: r["source"])
    spark = docs.sparkSession
    goal = targets([r["words"] for r in per_source], weights, cap)
    plan = [(r["source"], int(r["words"]), float(t), int(t // r["words"]) if r["words"] else 0, int(np.ceil(np.sqrt(r["n"])))) for r, t in zip(per_source, goal, strict=True)]
    schema = "source string, source_size long, target double, whole int, n_blocks int"
    plan_df = spark.createDataFrame(plan, schema)
    rows = rows.join(F.broadcast(plan_df), "source")  # at most max_sources rows of some 50 bytes
    salt = F.lit(seed)
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "_key", "_copy", salt)).withColumn("block", F.pmod(F.xxhash64("hash", F.lit("block")), F.col("n_blocks").cast("long")))
    # the last pass: blocks in permuted order until the target is reached
    blocks = rows.groupBy("source", "block", "whole", "source_size", "target").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", salt), "block")
    blocks = blocks.withColumn("position", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.col("target") - F.col("whole") * F.col("source_size")
    blocks = blocks.withColumn("room", part - (F.col("upto") - F.col("words")))  # words still to take when this block's turn comes
    blocks = cut(blocks.select("source", "block", "position", "room", F.when(F.col("room") <= 0, "out").when(F.col("room") >= F.col("words"), "in").otherwise("border").alias("state")))
    quotas = {r["source"]: r["quota"] for r in blocks.groupBy("source").agg(F.sum((F.col("state") != "out").cast("long")).alias("quota")).collect()}
    names = [p[0] for p in plan]
    counts = [quotas.get(s, 0) for s in names]
    matrix = split_quotas([whole * blocks_ + extra for (_, _, _, whole, blocks_), extra in zip(plan, counts, strict=True)], n_shards, seed)
    ends = spark.createDataFrame([(s, np.cumsum(matrix[:, i]).tolist()) for i, s in enumerate(names)], "source string, ends array<long>")
    # passes follow each other in the run of a source's blocks: pass p, position i is drawn as number p * n_blocks + i
    rows = rows.join(blocks, ["source", "block"]).join(F.broadcast(ends), "source")
    inside = Window.partitionBy("source", "block").orderBy("hash", "doc_id", "_key", "_copy")
    border = rows.where("state = 'border'").withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the document that crosses the target is taken if that ends nearer to it
    border = border.withColumn("extra", (F.col("upto") - F.col("size") / 2.0 <= F.col("room")).cast("int")).drop("upto")
    others = rows.where("state <> 'border'").withColumn("extra", (F.col("state") == "in").cast("int"))
    out = others.unionByName(border)
    number = lambda p: p * F.col("n_blocks") + F.col("position")
    shard = lambda p: F.least(F.size(F.filter("ends", lambda e: e <= number(p))), F.lit(n_shards - 1))
    copies = F.when(F.col("source_size") == 0, 0).otherwise(F.col("whole") + F.col("extra"))
    return out.select(
        "doc_id", "_key", "source", "_copy", "many", "size", "source_size", "target", copies.alias("copies"), F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(cap)))), shard).alias("shards"), F.col("hash").alias("place")
    )


def _segment(shard: str, place: str) -> list:
    """A shard is dealt to SEGMENTS tasks by the leading bits of the place, so tasks stay small when there are few shards."""
    return [F.col(shard), F.floor(F.col(place) / F.lit(float(2**64 / SEGMENTS)))]


def _place(seed: str, turn: str, shard: str):
    """Where a copy lies in its shard: rows are in the order of this hash."""
    return F.xxhash64(seed, turn, shard)


def dealt(drawn: DataFrame) -> DataFrame:
    """The rows of ``draw`` with (shards, places, ranks) of their copies: the shard and the place of each, as ``mix`` has them, and how
    many rows come before it in its segment of the shard. Only ids and numbers are shuffled."""
    rows = cut(drawn.withColumn("_row", F.monotonically_increasing_id()))  # numbers and short keys only
    copies = rows.where("copies > 0").select("_row", "doc_id", "_key", "_copy", F.col("place").alias("_seed"), F.posexplode(F.slice("shards", 1, F.col("copies"))).alias("_pass", "_shard"))
    copies = copies.withColumn("_place", _place("_seed", "_pass", "_shard"))
    order = Window.partitionBy(*_segment("_shard", "_place")).orderBy("_place", "doc_id", "_key", "_pass", "_copy", "_row")
    copies = copies.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    found = copies.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pass", "_shard", "_place", "_rank"))).alias("_copies"))
    parts = [F.coalesce(F.col(f"_copies.{c}"), F.array().cast(f"array<{kind}>")).alias(name) for c, kind, name in (("_shard", "int", "shards"), ("_place", "long", "places"), ("_rank", "long", "ranks"))]
    return rows.join(found, "_row", "left").select(*[c for c in drawn.columns if c not in ("shards", "place")], *parts)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every column of ``docs`` with ``_shard`` and ``_place``, each row as often as it is taken, sorted by
    ``_place`` inside each segment of a shard. Write it with ``partitionBy("_shard")`` for shard folders."""
    columns = docs.columns
    own, key, source, number, copies, shards, seed, turn, row = free_names(docs, "_id", "_key", "_from", "_copy", "_copies", "_shards", "_seed", "_pass", "_row")
    same = own, key, source
    rows = identified(docs)
    repeated = not rows.where("many").isEmpty()
    drawn = draw(docs, rows=rows, **options).withColumnsRenamed({"copies": copies, "shards": shards, "place": seed})
    drawn = drawn.select(*[F.col(c).alias(f"{n}2") for c, n in zip(SAME, same, strict=True)], F.col("_copy").alias(f"{number}2"), F.col("many").alias(f"{row}2"), copies, shards, seed)
    keyed = docs.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64("text"), source: _source_key()})
    equal = [keyed[c].eqNullSafe(drawn[f"{c}2"]) for c in same]
    wanted = [*columns, F.posexplode(F.slice(shards, 1, F.col(copies))).alias(turn, "_shard"), seed]
    taken = drawn.where(F.col(copies) > 0)
    rows = keyed.join(taken.where(f"not `{row}2`"), equal).select(*wanted)
    if repeated:
        # equal rows are numbered like those that were drawn; only these are stored with their texts
        many = drawn.where(F.col(f"{row}2"))
        mine = keyed.join(many.select(*[f"{c}2" for c in same]).distinct(), equal, "left_semi")
        mine = numbered(cut(mine.select(F.struct(*columns).alias("all"), *[F.col(c).alias(n) for c, n in zip(same, SAME, strict=True)], F.monotonically_increasing_id().alias("_row"))))
        again = [mine[n].eqNullSafe(many[f"{c}2"]) for n, c in zip(SAME, same, strict=True)]
        found = mine.join(many.where(F.col(copies) > 0), [*again, F.col("_copy") == F.col(f"{number}2")])
        rows = rows.unionByName(found.select("all", F.posexplode(F.slice(shards, 1, F.col(copies))).alias(turn, "_shard"), seed).select("all.*", turn, "_shard", seed))
    rows = rows.withColumn("_place", _place(seed, turn, "_shard")).drop(turn, seed)
    return rows.repartition(*_segment("_shard", "_place")).sortWithinPartitions("_shard", "_place")
