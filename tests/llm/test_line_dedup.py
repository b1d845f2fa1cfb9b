import hashlib
import random

import duckdb
import pytest

from tidemark.llm import line_dedup as ld
from tidemark.llm.queries import ORACLE_SQL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_cuckoo_filter():
    keys = [hashlib.md5(b"%d" % i).digest() for i in range(5000)]
    f = ld.CuckooFilter.of(keys)
    assert all(k in f for k in keys) and sum(hashlib.md5(b"x%d" % i).digest() in f for i in range(5000)) < 25
    again = ld.CuckooFilter.from_bytes(f.to_bytes())
    for k in keys[::2]:
        assert again.remove(k)
    assert all(k in again for k in keys[1::2]) and sum(k in again for k in keys[::2]) < 25
    tiny = ld.CuckooFilter(4)
    held = [k for k in keys if tiny.add(k)]
    assert len(held) < 200 and all(k in tiny for k in held)  # a full table refuses and forgets nothing
    assert ld.CuckooFilter.of([]).to_bytes()


def test_keys():
    assert ld.line_key(b"x" * 39) is None and ld.line_key(b" \x0b" + b"X" * 40 + b"\t\r") == ld.line_key(b"x" * 40)
    assert ld.line_key("é".encode() * 39) is None and ld.line_key("é".encode() * 40) and ld.line_key("É".encode() * 40) != ld.line_key("é".encode() * 40)
    assert ld.line_key("\u00a0".encode() + b"x" * 40) != ld.line_key(b"x" * 40)


@pytest.mark.parametrize("filter_bytes", [ld.FILTER_BYTES, 0])
def test_against_sql(spark, odd_docs, monkeypatch, filter_bytes):
    monkeypatch.setattr(ld, "FILTER_BYTES", filter_bytes)
    rng = random.Random(3)
    lines = ["line number %d that is long enough to count for something" % i for i in range(12)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) for x in rng.choices(lines, k=rng.randint(1, 6)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate([None, "", "\n"])]
    rows += [(200 + r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null and doc_id not in (51, 80, 93)").collect()]
    con = duckdb.connect()
    con.sql("create table documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], sha(r["kept_text"])) for r in found}
    want = {r[0]: r[1:] for r in con.sql("select doc_id, n_lines, n_dropped, kept_sha256 from (" + ORACLE_SQL["op10_line_dedup"] + ")").fetchall()}
    assert got == want and sum(v[1] for v in got.values()) > 20


def tables(index):
    return [sorted(map(tuple, df.collect())) for df in (index.references.distinct(), index.counts, index.hot)]


def check_filters(index):
    """The kept filters hold exactly the hot keys: one fingerprint each, and all are found."""
    kept = {r["shard"]: ld.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()}
    hot = [bytes(r["key"]) for r in index.hot.collect()]
    assert all(k in kept[ld.shard_of(k, index.shards)] for k in hot) and sum(int((f.table > 0).sum()) for f in kept.values()) == len(hot)


def test_index_is_reversible(spark, tmp_path):
    line = "a boilerplate line that is certainly long enough, again and again"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(6)] + [(9, "nothing shared here at all, but long enough to count")], "doc_id long, text string")
    few = ld.LineIndex.build(docs.where("doc_id < 4"))
    assert few.hot.count() == 0
    grown = few.insert(docs.where("doc_id >= 4"))
    assert [(r["n_docs"], r["keeper"]) for r in grown.hot.collect()] == [(6, 5)]
    check_filters(grown)
    assert tables(grown.insert(docs)) == tables(grown)  # again: no change
    less = grown.delete(spark.createDataFrame([(5,), (77,), (None,)], "doc_id long"))
    assert [(r["n_docs"], r["keeper"]) for r in less.hot.collect()] == [(5, 4)]
    kept = {r["doc_id"]: r["kept_text"] for r in ld.dedup_lines(docs.where("doc_id <> 5"), index=less).collect()}
    assert kept[4].startswith(line) and kept[0] == "own 0"
    less.save(str(tmp_path / "index"))
    back = ld.LineIndex.load(spark, str(tmp_path / "index")).delete(spark.createDataFrame([(4,), (9,)], "doc_id long"))
    check_filters(back)
    assert tables(back) == tables(few)
    assert {r["n_dropped"] for r in ld.dedup_lines(docs.where("doc_id < 4"), index=back).collect()} == {0}


def test_edits_in_any_order_equal_a_build(spark, monkeypatch):
    """Filters grow out of their tables, shrink again, and always hold just the hot keys."""
    monkeypatch.setattr(ld, "SHARD_KEYS", 20)
    monkeypatch.setattr(ld.LineIndex, "COMPACT", 2)
    rng = random.Random(8)
    lines = ["line %d of a pool, with enough letters in it to be counted" % i for i in range(300)]
    texts = {i: "\n".join(rng.sample(lines[: 60 if i < 40 else 300], 25)) for i in range(120)}
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").coalesce(2)
    have = set(range(40))
    index = ld.LineIndex.build(frame(have))
    assert index.shards > 1
    for step, ids in enumerate([range(40, 120), [*range(10, 30), *range(70, 110)], range(60, 110), range(0, 100)]):
        if step % 2 == 0:
            index, have = index.insert(frame(ids)), have | set(ids)
        else:
            index, have = index.delete(spark.createDataFrame([(i,) for i in ids], "doc_id long")), have - set(ids)
        check_filters(index)
        assert tables(index) == tables(ld.LineIndex.build(frame(have)))


def test_null_ids_lose_the_lines_of_their_own_texts(spark):
    pool = ["shared line %d, long enough to be counted by the index" % i for i in range(200)]
    rows = [(i, "\n".join(pool)) for i in range(5)] + [(None, pool[i % 200] + f"\nown {i}") for i in range(1000)] + [(7, pool[0]), (7, pool[1] + "\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ld.LineIndex.build(docs).doomed(docs).collect()
    assert max(len(r["keys"]) for r in found if r["doc_id"] is None) == 1
    got = sorted(r["kept_text"] for r in ld.dedup_lines(docs).collect() if r["doc_id"] is None)
    assert got == sorted(f"own {i}" for i in range(1000))
    assert sorted(r["kept_text"] for r in ld.dedup_lines(docs).collect() if r["doc_id"] == 7) == sorted([pool[0], pool[1] + "\nx"])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = ld.dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count() and ld.dedup_lines(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (51, 80, None)}
    assert (by[60]["n_lines"], by[60]["n_dropped"]) == (3, 2) and by[92]["n_dropped"] == 0 and by[70]["kept_text"] == "" and by[70]["n_lines"] == 1
    out = ld.without_hot_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count() and ld.without_hot_lines(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[70] is None and "\n" not in texts[60]
