"""Reversible line dedup: exact reference-count tables with sharded cuckoo filters in front of them.

A line's key is the line without ASCII blanks at both ends, A-Z lower-cased; keys of MIN_CHARS code points or more count.
A ``LineIndex`` keeps the references, one row for each (key, document), the counts, (key, n_docs, keeper) with the largest id
that holds the key, the hot keys, those counted in MIN_DOCS documents or more, and a cuckoo filter of the hot keys for each shard of the key
space. ``insert`` and ``delete`` count only the keys of the changed documents anew, and add the keys that reach the limit to
the kept filters and remove those that fall below it. So nothing is ever lost: a key that falls below comes back to all its texts.

The filters tell, while texts are read, which lines can be hot at all; only those few are looked up in the exact table, so a
filter's false positives cost a look-up and change nothing. They are sent to the executors only while all of them together
take at most FILTER_BYTES, measured; beyond that every counted line is looked up, with the same result.

Null and empty texts are one empty line. Lines repeat within a document without counting twice. Ids that repeat are one
document for counting. Rows with a null id count for nothing and lose lines like any other that is not the largest id. Texts
of any length are taken whole; equal rows are treated alike and an empty table gives an empty result. Columns other than id and
text are not read, so they cannot clash; ``without_hot_lines`` hands them on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, by_batch, free_names, id_and_text, raw_texts
from tidemark.session import cut

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 50_000  # hot keys in a filter, about
FILTER_BYTES = 64 << 20
_STRIP = BLANKS.encode()


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte key of a line, None if it is too short to count."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lives in one of two buckets, each found from the other by its fingerprint."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 16, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(0, (int(capacity / 0.85) // self.SLOTS).bit_length())
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        mask = len(self.table) - 1
        first = int.from_bytes(key[:8], "little") >> 16 & mask
        return mark, first, first ^ (mark * 0x5BD1E995 >> 8 & mask)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return mark in self.table[a] or mark in self.table[b]

    def add(self, key: bytes) -> bool:
        """False if the table is too full; it then holds what it held before."""
        mark, a, b = self._places(key)
        moves, at, mask = [], a, len(self.table) - 1
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        for kick in range(self.KICKS):
            slot = (kick * 7 + mark) % self.SLOTS
            moves.append((at, slot, int(self.table[at, slot])))
            self.table[at, slot], mark = mark, moves[-1][2]
            at ^= mark * 0x5BD1E995 >> 8 & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot, old in reversed(moves):
            self.table[at, slot] = old
        return False

    def remove(self, key: bytes) -> bool:
        """Only for keys that were added."""
        mark, a, b = self._places(key)
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        capacity = max(16, len(keys))
        while True:
            out = cls(capacity)
            if all(out.add(k) for k in keys):
                return out
            capacity *= 2


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[10:14], "little") % shards


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The exact table: (key, doc_id), one row for each key of a document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            found = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
            keys += found
            ids += [doc] * len(found)
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return by_batch(id_and_text(docs).where("doc_id is not null"), run, "key binary, doc_id long")


def tally(table: DataFrame) -> DataFrame:
    """(key, n_docs, keeper) of references. Partial counts are made before the shuffle."""
    return table.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def filters(hot: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): the cuckoo filter of each shard's hot keys, built where the shard's keys are."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([CuckooFilter.of(sorted(table.column("key").to_pylist())).to_bytes()], pa.binary())], names=["shard", "filter"])

    return hot.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard long, filter binary")


def _shard(shards: int):
    """Bytes 10 to 13 of the key as a little-endian number, modulo ``shards``."""
    digits = F.concat(*[F.hex(F.substring("key", i, 1)) for i in (14, 13, 12, 11)])
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(shards))


def edited_filters(kept: DataFrame, edits: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) after keys came (up) or went: ``edits`` has (key, up). A filter that is too full for its new keys is built
    anew from the shard's hot keys."""
    lists = [F.collect_list(F.when(F.col("up") == up, F.col("key"))).alias(name) for up, name in ((True, "came"), (False, "went"))]
    marked = edits.select(_shard(shards).alias("shard"), "key", "up").groupBy("shard").agg(*lists)  # about SHARD_KEYS at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, came, went in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            sieve = CuckooFilter.from_bytes(data) if data else CuckooFilter()
            gone = all([sieve.remove(k) for k in went or ()])
            out.append(sieve.to_bytes() if gone and all(sieve.add(k) for k in came or ()) else None)
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["shard", "filter"])

    touched = cut(by_batch(marked.join(kept, "shard", "left").select("shard", "filter", "came", "went"), run, "shard long, filter binary"))
    full = touched.where("filter is null").select(F.col("shard").alias("_shard"))
    rebuilt = filters(hot.join(full, _shard(shards) == F.col("_shard"), "left_semi"), shards)
    rest = kept.join(touched.select("shard"), "shard", "left_anti")
    return cut(rest.unionByName(touched.where("filter is not null")).unionByName(rebuilt))


class LineIndex:
    """The tables of the docstring above. Each edit gives a new index; tables that an edit does not touch are shared. References
    and counts that are only read through are computed when an edit or ``save`` first needs them."""

    COMPACT = 8  # edits after which references and counts are stored as one table each

    def __init__(self, references: DataFrame, counts: DataFrame, hot: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int, edits: int | None = None) -> None:
        self.references, self.counts, self.hot, self.filters = references, counts, hot, filters
        self.shards, self.min_chars, self.min_docs, self.edits = shards, min_chars, min_docs, edits

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        table = references(docs, min_chars)
        counts = tally(table)
        hot = cut(counts.where(F.col("n_docs") >= min_docs))
        shards = max(1, hot.count() // SHARD_KEYS)
        return cls(table, counts, hot, filters(hot, shards), shards, min_chars, min_docs)

    def _stored(self) -> LineIndex:
        if self.edits is None or self.edits >= self.COMPACT:
            table = cut(self.references.distinct())
            counts = cut(tally(table)) if self.edits is None else cut(self.counts)
            return LineIndex(table, counts, self.hot, cut(self.filters), self.shards, self.min_chars, self.min_docs, 0)
        return self

    def _changed(self, table: DataFrame, touched: DataFrame) -> LineIndex:
        """The index with these references, of which only those of the ``touched`` keys differ."""
        anew = cut(tally(table.join(touched, "key", "left_semi")))
        is_hot = anew.where(F.col("n_docs") >= self.min_docs)
        was_hot = self.hot.join(touched, "key", "left_semi").select("key")
        came = is_hot.select("key").join(was_hot, "key", "left_anti").withColumn("up", F.lit(True))
        went = was_hot.join(is_hot.select("key"), "key", "left_anti").withColumn("up", F.lit(False))
        hot = cut(self.hot.join(touched, "key", "left_anti").unionByName(is_hot))
        counts = self.counts.join(touched, "key", "left_anti").unionByName(anew)
        sieves = edited_filters(self.filters, came.unionByName(went), hot, self.shards)
        return LineIndex(table, counts, hot, sieves, self.shards, self.min_chars, self.min_docs, self.edits + 1)

    def insert(self, docs: DataFrame) -> LineIndex:
        """After ``docs`` are added. Lines of documents that are known already are added once."""
        old = self._stored()
        new = cut(references(docs, self.min_chars).distinct().join(old.references, ["key", "doc_id"], "left_anti"))
        return old._changed(old.references.unionByName(new), cut(new.select("key").distinct()))

    def delete(self, ids: DataFrame) -> LineIndex:
        """After the documents in ``ids`` (doc_id) are deleted."""
        old, ids = self._stored(), cut(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
        touched = cut(old.references.join(ids, "doc_id", "left_semi").select("key").distinct())
        return old._changed(old.references.join(ids, "doc_id", "left_anti").select("key", "doc_id"), touched)

    def save(self, folder: str) -> None:
        """As Parquet tables in a new folder that all machines see."""
        kept = self._stored()
        for name in ("references", "counts", "hot", "filters"):
            getattr(kept, name).write.parquet(f"{folder}/{name}")
        kept.hot.sparkSession.createDataFrame([(self.shards, self.min_chars, self.min_docs)], "shards int, min_chars int, min_docs int").write.parquet(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LineIndex:
        tables = [spark.read.parquet(f"{folder}/{name}") for name in ("references", "counts", "hot", "filters")]
        return cls(*tables, *spark.read.parquet(f"{folder}/settings").first(), edits=0)

    def doomed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_hash, keys): the keys whose lines each document loses; documents that lose none are left out. Rows with
        the same id but other texts are told apart by the hash, so a list holds the lines of one text."""
        texts = _hashed(id_and_text(docs))
        parts = None
        if self.hot.count() * 2 <= FILTER_BYTES and (self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= FILTER_BYTES:
            parts = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}
        found = _suspects(texts, parts, self.shards, self.min_chars)
        lost = found.join(self.hot.select("key", "keeper"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))


def _hashed(texts: DataFrame, name: str = "text_hash") -> DataFrame:
    return texts.withColumn(name, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _suspects(texts: DataFrame, parts: dict[int, bytes] | None, shards: int, min_chars: int) -> DataFrame:
    """(key, doc_id, text_hash) of the counted lines; with filters, of those that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = {s: CuckooFilter.from_bytes(b) for s, b in (parts or {}).items()}
        seen: dict[bytes, bool] = {}
        for batch in batches:
            keys, at = [], []
            for i, text in enumerate(raw_texts(batch.column(1))):
                for key in {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}:
                    if parts is None:
                        passes = True
                    elif (passes := seen.get(key)) is None:
                        sieve = sieves.get(shard_of(key, shards))
                        passes = sieve is not None and key in sieve
                        if len(seen) < 200_000:
                            seen[key] = passes
                    if passes:
                        keys.append(key)
                        at.append(i)
            rows = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(keys, pa.binary()), batch.column(0).take(rows), batch.column(2).take(rows)], names=["key", "doc_id", "text_hash"])

    return texts.mapInArrow(run, "key binary, doc_id long, text_hash long")


def strip_lines(text: bytes, keys: list[bytes] | None, min_chars: int = MIN_CHARS) -> tuple[bytes, int, int]:
    """The text without the lines of these keys, its number of lines and how many went."""
    if not keys:
        return text, text.count(b"\n") + 1, 0
    gone, lines = set(keys), text.split(b"\n")
    stay = [line for line in lines if line_key(line, min_chars) not in gone]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row of ``docs``. Without an index kept so far, one of ``docs`` is built."""
    index = index or LineIndex.build(docs, min_chars, min_docs)
    min_chars = index.min_chars
    lost = index.doomed(docs).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    texts = _hashed(id_and_text(docs))
    joined = texts.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "keys")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [strip_lines(t, k, min_chars) for t, k in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        text = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
        return pa.record_batch([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), text], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return by_batch(joined, run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def without_hot_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows and columns of ``docs`` with the remaining text; ``n_chars``, if there, is counted anew. Untouched texts,
    null ones included, stay as they are."""
    lost = LineIndex.build(docs, min_chars, min_docs).doomed(docs)
    own, gone, mark = free_names(docs, "_id", "_keys", "_hash")
    lost = lost.withColumnsRenamed({"doc_id": own, "keys": gone, "text_hash": f"{mark}2"})
    hashed = _hashed(docs, mark)
    joined = hashed.join(lost, hashed["doc_id"].cast("long").eqNullSafe(lost[own]) & (hashed[mark] == lost[f"{mark}2"]), "left")
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)[:-1]
        texts = batch.column(at)
        keys = batch.column(len(names)).to_pylist()
        if any(keys):
            changed = [strip_lines(t, k, min_chars)[0] if k else None for t, k in zip(raw_texts(texts), keys, strict=True)]
            new = pa.array(changed, pa.binary()).cast(texts.type)
            columns[at] = pc.coalesce(new, texts)
            if "n_chars" in names:
                count = pc.utf8_length(new).cast(batch.column(names.index("n_chars")).type)
                columns[names.index("n_chars")] = pc.coalesce(count, batch.column(names.index("n_chars")))
        return pa.record_batch(columns, names=names)

    return by_batch(joined.select(*[hashed[c] for c in names], gone), run, docs.schema)
