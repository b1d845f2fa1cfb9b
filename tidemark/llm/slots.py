"""Sharding through fixed virtual slots, with DataFrame functions only.

Each record is hashed into one of SLOTS virtual slots by (id, text). The bytes and rows of every slot are summed; a small
versioned map sends slots to shards. All versions of the map are stored; the last one is read, edited and stored under the
next version, so only the records of moved slots move. The map and the sums have SLOTS rows, whatever the input, and are
handled on the driver.

Equal rows would all share a slot. Where equal rows together outweigh HOT average slots, they are hashed once more with their
position, so any number of them spreads evenly over all slots; equal rows are interchangeable.

Nulls: a null text has no bytes, a null id hashes like any other value. Rows with the same id but different texts may part.
Texts of any length are one record. An empty table gives an empty result. Extra columns are not read, so they cannot clash."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut, ensure_shared_dir

SLOTS, HOT = 8192, 16


@dataclass(frozen=True)
class SlotMap:
    """shards[s] is the shard of slot s. Each edit gives a new map with the next version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, n_shards, tuple(s % n_shards for s in range(slots)))

    def rebalanced(self, weights: list[int], tolerance: float = 0.0) -> SlotMap:
        """Move, else swap, slots between the heaviest and the lightest shard until that no longer narrows their gap, or
        the gap is at most ``tolerance`` of a shard's mean weight."""
        shards, members, load = list(self.shards), [set() for _ in range(self.n_shards)], [0] * self.n_shards
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
            if weights[slot]:
                members[shard].add(slot)
        limit = tolerance * sum(weights) / self.n_shards
        for _ in range(20 * len(shards)):
            heavy, light = max(range(self.n_shards), key=lambda k: (load[k], -k)), min(range(self.n_shards), key=lambda k: (load[k], k))
            gap = load[heavy] - load[light]
            if gap <= max(1, limit):
                break
            near = lambda moved: (abs(gap - 2 * moved), moved)
            best = min(((near(weights[s]), (s,), ()) for s in members[heavy] if weights[s] < gap), default=None)
            if best is None or best[0][0] > gap // 2:
                a, b = sorted(members[heavy], key=lambda s: (weights[s], s)), sorted(members[light], key=lambda s: (weights[s], s))
                i = 0
                for s in a:  # the partner that brings the difference nearest to half the gap
                    while i + 1 < len(b) and near(weights[s] - weights[b[i + 1]]) <= near(weights[s] - weights[b[i]]):
                        i += 1
                    if b and 0 < (d := weights[s] - weights[b[i]]) < gap and (best is None or near(d) < best[0]):
                        best = near(d), (s,), (b[i],)
            if best is None or best[0][0] >= gap:
                break
            for there, back, slots in ((light, heavy, best[1]), (heavy, light, best[2])):
                for s in slots:
                    shards[s] = there
                    members[back].discard(s)
                    members[there].add(s)
                    load[there] += weights[s]
                    load[back] -= weights[s]
        return SlotMap(self.version + 1, self.n_shards, tuple(shards))

    def grown(self, weights: list[int]) -> SlotMap:
        """One more shard, which takes slots from the heaviest shards until it holds its share; no other slot moves."""
        shards, load = list(self.shards), [0] * (self.n_shards + 1)
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
        share = sum(weights) / (self.n_shards + 1)
        for slot in sorted(range(len(shards)), key=lambda s: (-weights[s], s)):
            if load[shards[slot]] - weights[slot] >= share * 0.98 and load[-1] + weights[slot] <= share * 1.02:
                load[shards[slot]] -= weights[slot]
                load[-1] += weights[slot]
                shards[slot] = self.n_shards
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(shards))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, n_shards, slot, shard): the form in which maps are stored, all versions in one table."""
        return spark.range(len(self.shards)).select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), F.col("id").alias("slot"), _lookup(self.shards, "id").cast("int").alias("shard"))

    @classmethod
    def load(cls, table: DataFrame, version: int | None = None) -> SlotMap:
        """The newest stored map, or the one of ``version``."""
        rows = table.where(F.col("version") == version) if version else table.join(table.agg(F.max("version").alias("version")), "version")
        found = sorted((r["slot"], r["shard"], r["version"], r["n_shards"]) for r in rows.collect())  # one row a slot
        return cls(found[0][2], found[0][3], tuple(r[1] for r in found))


class MapStore:
    """All versions of a map in one folder that every machine sees, each version written once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.versions = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> MapStore:
        """A store whose folder holds a map already."""
        out = cls(spark, folder)
        out.versions = spark.read.parquet(folder).agg(F.max("version")).first()[0]
        return out

    def append(self, slot_map: SlotMap) -> None:
        if slot_map.version != self.versions + 1:
            raise ValueError(f"version {slot_map.version} does not follow {self.versions}")
        slot_map.frame(self.spark).coalesce(1).write.mode("append").partitionBy("version").parquet(self.folder)
        self.versions += 1

    def load(self, version: int | None = None) -> SlotMap:
        return SlotMap.load(self.spark.read.parquet(self.folder), version or self.versions)


def _lookup(values, at: str):
    """values[at], as an array literal that the optimizer folds."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), (F.col(at) + 1).cast("int"))


def placed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot). Size: UTF-8 bytes of the text, null: none, plus 8."""
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; partial sums are made before the shuffle, and ``slots`` rows reach the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["n"]
    return size, count


def scattered(rows: DataFrame, size: list[int]) -> DataFrame:
    """``rows`` (with their position, _row) with the records of heavy groups of equal rows hashed anew, by slot and position.
    There are less than slots / HOT such groups."""
    limit = HOT * sum(size) / len(size)
    if not (heavy := [s for s, b in enumerate(size) if b > limit]):
        return rows
    same = ["virtual_slot", "doc_id", "text_crc32", "size"]
    groups = rows.where(F.col("virtual_slot").isin(heavy)).groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") * F.col("size") > limit))
    groups = cut(groups.select(*[F.col(c).alias(f"_{c}") for c in same]))
    found = rows.join(F.broadcast(groups), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left")
    again = F.pmod(F.xxhash64("virtual_slot", "_row"), F.lit(len(size)))
    return found.withColumn("virtual_slot", F.when(F.col("_virtual_slot").isNull(), F.col("virtual_slot")).otherwise(again)).select(*rows.columns)


def shard(docs: DataFrame, n_shards: int = 24, slots: int = SLOTS, store: MapStore | None = None) -> tuple[DataFrame, MapStore]:
    """Rows with their shard and place in it, and the store with the map that was used as its last version.

    The store's last map is read (a new store starts with slot mod shards), grown to ``n_shards`` if it has fewer, and rebalanced
    by bytes; what changed is stored as the next version. ``shard_if_grown`` is a row's shard after one more shard is added.
    A row's place counts the rows of its shard's earlier slots and the rows before it in its own slot, so only single slots
    are sorted, each in its own task."""
    spark = docs.sparkSession
    rows = cut(placed(docs, slots).withColumn("_row", F.monotonically_increasing_id()))  # some 40 bytes a row; texts are read once
    size, count = slot_sums(rows, slots)
    if (spread := scattered(rows, size)) is not rows:
        rows, (size, count) = spread, slot_sums(spread, slots)
    if store is None:
        store = MapStore(spark, f"{ensure_shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    if not store.versions:
        store.append(SlotMap.initial(n_shards, slots))
    while (last := store.load()).n_shards < n_shards:
        store.append(last.grown(size))
    if last.n_shards > n_shards:
        raise ValueError(f"the stored map has {last.n_shards} shards, more than {n_shards}")
    if (edited := last.rebalanced(size)).shards != last.shards:
        store.append(edited)
    slot_map = store.load()
    base, filled = [0] * slots, [0] * n_shards
    for s, to in enumerate(slot_map.shards):
        base[s], filled[to] = filled[to], filled[to] + count[s]
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "_row")
    out = rows.withColumn("slot", F.row_number().over(inside) - 1 + _lookup(base, "virtual_slot")).withColumn("shard", _lookup(slot_map.shards, "virtual_slot").cast("int"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(slot_map.version).alias("map_version"), _lookup(slot_map.grown(size).shards, "virtual_slot").cast("int").alias("shard_if_grown"),
    ), store
