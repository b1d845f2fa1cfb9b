import random
import zlib

import pytest
import xxhash

from tidemark.llm import slots
from tidemark.llm.slots import SlotMap


def loads(m, w):
    out = [0] * m.n_shards
    for s, k in enumerate(m.shards):
        out[k] += w[s]
    return out


@pytest.mark.parametrize("seed, n", [(0, 4096), (1, 300), (2, 64)])
def test_rebalancing_evens_bytes_out(seed, n):
    rng = random.Random(seed)
    w = [int(rng.lognormvariate(8, 1)) for _ in range(n)]
    first = SlotMap.initial(24, n)
    m = first.rebalanced(w)
    before, after = loads(first, w), loads(m, w)
    assert m.version == 2 and sum(after) == sum(w) and max(after) - min(after) <= max(w) and max(after) - min(after) <= max(before) - min(before)
    assert max(after) - min(after) < 0.02 * sum(w) / 24 or n < 1000


def test_growing_moves_slots_only_to_the_new_shard():
    rng = random.Random(4)
    w = [rng.randrange(1, 1000) for _ in range(4096)]
    m = SlotMap.initial(24, 4096).rebalanced(w)
    g = m.grown(w)
    assert all(a == b or b == 24 for a, b in zip(m.shards, g.shards, strict=True)) and (g.version, g.n_shards) == (3, 25)
    assert abs(loads(g, w)[24] - sum(w) / 25) < 0.05 * sum(w) / 25
    assert SlotMap.initial(3, 10).rebalanced([0] * 10).shards == SlotMap.initial(3, 10).shards


def test_maps_are_stored_by_version(spark):
    a = SlotMap.initial(5, 64)
    b = a.grown([1] * 64)
    table = a.frame(spark).unionByName(b.frame(spark))
    assert SlotMap.load(table) == b and SlotMap.load(table, 1) == a


def brute_place(docs, m, virtual):
    """Rows of each shard in the order of their slots, then of their ids: (shard, place) of every row."""
    found, filled = [], [0] * m.n_shards
    for _, rows in sorted((s, [r for r, v in zip(docs, virtual, strict=True) if v == s]) for s in set(virtual)):
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
            found.append((r, filled[m.shards[_]]))
            filled[m.shards[_]] += 1
    return found


def test_rows(spark, odd_docs, no_docs):
    found, store = slots.shard(odd_docs, 24)
    m, rows = store.load(), found.collect()
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))) for r in odd_docs.collect())
    for k in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert all(m.shards[r["virtual_slot"]] == r["shard"] for r in rows)
    plain = [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]
    want = brute_place(plain, m, [r["virtual_slot"] for r in rows])
    assert sorted(map(str, want)) == sorted(str((p, r["slot"])) for p, r in zip(plain, rows, strict=True))
    assert all(r["shard_if_grown"] in (r["shard"], 24) and r["grown_shard"] is None for r in rows)
    assert slots.shard(no_docs, 24)[0].count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [r["s"] for r in slots.shard(docs, 24)[0].groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()]
    assert len(sums) == 24 and max(sums) - min(sums) < 0.01 * sum(sums) / 24


def test_the_slot_is_the_hash_of_id_and_text(spark):
    rows = [(5, "abc"), (None, "x"), (7, None), (5, "abd")]
    got = {(r["doc_id"], r["size"]): r["virtual_slot"] for r in slots.placed(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()}
    for doc, text in rows:
        h = 42  # a null leaves the hash as it is
        h = h if doc is None else xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), h)
        h = h if text is None else xxhash.xxh64_intdigest(text.encode(), h)
        signed = h - (1 << 64) if h >> 63 else h
        assert got[doc, len(text or "") + 8] in {signed % 1000} | {v for k, v in got.items() if k == (5, 11)}


def test_equal_rows_spread_over_all_shards(spark):
    rows = spark.createDataFrame([(None, "the same text")] * 2000 + [(i, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(7)
    found = slots.shard(rows, 24)[0].collect()
    load, same = [0] * 24, [0] * 24
    for r in found:
        load[r["shard"]] += r["size"]
        same[r["shard"]] += r["doc_id"] is None
    assert len(found) == 6000 and max(load) - min(load) < 0.02 * sum(load) / 24 and min(same) > 0.3 * 2000 / 24
    for k in range(24):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))


def test_a_stored_map_is_read_edited_and_grown(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    store = slots.MapStore(spark, str(tmp_path / "maps"))
    first = {r["doc_id"]: r for r in slots.shard(docs, 6, 512, store)[0].collect()}
    assert store.versions == 2 and store.load(1) == SlotMap.initial(6, 512)
    again = slots.MapStore.open(spark, str(tmp_path / "maps"))
    same = {r["doc_id"]: r for r in slots.shard(docs, 6, 512, again)[0].collect()}
    assert again.versions == 2 and all(first[d]["shard"] == r["shard"] for d, r in same.items())  # nothing to edit
    promised = again.load().grown(slots.slot_sums(slots.placed(docs, 512), 512)[0])
    more = {r["doc_id"]: r for r in slots.shard(docs, 7, 512, again)[0].collect()}
    assert again.load(3).shards == promised.shards and again.load(3).n_shards == 7
    assert all(promised.shards[r["virtual_slot"]] == r["shard_if_grown"] for r in same.values()) and sum(r["shard"] == 6 for r in more.values()) > 0
    with pytest.raises(ValueError):
        again.append(SlotMap.initial(7, 512))
    with pytest.raises(ValueError):
        slots.shard(docs, 6, 512, again)
