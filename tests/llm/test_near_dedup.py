import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import near_dedup as nd
from tidemark.llm.graph import components
from tidemark.llm.queries import ORACLE_SQL


def brute(docs, percent):
    sets, up = {}, {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        up[doc] = doc
    root = lambda x: x if up[x] == x else root(up[x])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else rng.choice(words) + "x%d" % rng.randrange(999) for w in words)


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        words = prose(rng, rng.choice([3, 6, 40, 150, 400])).split()
        rows += [(len(rows) + k, edited(rng, words, rng.choice([0, 0.005, 0.02, 0.03, 0.05, 0.2]))) for k in range(rng.choice([1, 3, 25]))]
    shared = prose(rng, 60)  # a passage that everyone quotes
    rows += [(1000 + i, prose(rng, 40) + " " + shared + " " + prose(rng, 40)) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block, lists", [(10**6, 32), (2000, 10**6), (2000, 1)])
def test_against_all_pairs(spark, copies, monkeypatch, percent, block, lists):
    """In whole groups, in blocks of groups, and in blocks of single lists."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "LISTS_FROM", lists)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(docs, percent).collect()}
    assert got == brute(copies, percent)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = nd.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and nd.near_duplicates(no_docs).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["kept"] and r["component_id"] is None for r in by[None])
    assert {r["component_id"] for i in (*range(40, 46), 50, 51, 80) for r in by[i]} == {40}
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["component_id"] == i and by[i][0]["kept"] for i in (70, 71, 72, 73))
    kept = nd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(r["doc_id"] for r in rows if r["kept"] and r["doc_id"] is not None)


def test_sql_agrees_on_a_fixture(spark, copies):
    con = duckdb.connect()
    rows = [(i, t) for i, t in copies if len(t) < 2000]
    con.sql("create table documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["op6_near_dedup"]).fetchall())


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(50)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = chain + star + loose + [(7, 7), *chain[:3]]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tail_bound():
    assert nd.at_least(16, 0.85) >= 3 and nd.at_least(64, 0.85) >= 35 and nd.at_least(1, 0.85) == 1
    assert np.all(np.diff(nd.shingles(b"a b c d e f g h").astype(float)) > 0) and len(nd.shingles(b"a b")) == 1


def brute_links(values, side, percent):
    """Components by comparing all pairs."""
    up = list(range(len(values)))
    root = lambda x: x if up[x] == x else root(up[x])
    across = len(set(side)) > 1
    for a in range(len(values)):
        for b in range(a):
            i = len(set(values[a]) & set(values[b]))
            if i and (side[a] != side[b] or not across) and 100 * i >= percent * (len(values[a]) + len(values[b]) - i):
                up[root(a)] = root(b)
    return [root(i) for i in range(len(values))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("percent", [80, 85, 95])
def test_links_among_sets_of_all_sizes(seed, percent):
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    values = []
    for size in (1, 2, 6, 20, 63, 64, 65, 70, 90, 300):
        base = rng.choice(hashes, size, replace=False)
        for _ in range(12):
            changed = base.copy()
            at = rng.random(size) < rng.choice([0, 0.02, 0.08, 0.12, 0.2, 0.5])
            changed[at] = rng.choice(hashes, at.sum())
            values.append(np.unique(changed[: max(1, int(size * rng.choice([1, 1, 0.9])))]))
    values = [values[i] for i in rng.permutation(len(values))]
    for side in (np.zeros(len(values), int), rng.integers(0, 2, len(values))):
        up = list(range(len(values)))
        root = lambda x: x if up[x] == x else root(up[x])  # noqa: E731, B023
        links = nd.links_among(values, side, percent)
        for a, b in links:
            up[root(a)] = root(b)
        assert len(links) == len(values) - len({root(i) for i in range(len(values))})  # a forest
        assert same_partition([root(i) for i in range(len(values))], brute_links(values, side, percent))


@pytest.mark.parametrize("n, family, limit", [(100_000, 100_000, 60), (100_000, 50, 60), (20_000, 20_000, 30)])
def test_many_short_near_alike_sets(n, family, limit):
    """Six shingles each, five of them those of the family; and families whose members are linked."""
    began, rng = time.time(), np.random.default_rng(n + family)
    base = rng.integers(0, 2**63, (n // family, 6)).astype(np.uint64)
    rows = np.repeat(base, family, axis=0)
    rows[np.arange(n), rng.integers(0, 6, n)] = rng.integers(0, 2**63, n).astype(np.uint64)
    assert nd.links_among([np.sort(r) for r in rows], np.zeros(n, int), 85) == []
    long = np.concatenate([np.tile(rng.integers(0, 2**63, 40).astype(np.uint64), (n // 5, 1)), rng.integers(0, 2**63, (n // 5, 1)).astype(np.uint64)], axis=1)
    assert len(nd.links_among([np.sort(r) for r in long], np.zeros(len(long), int), 85)) == n // 5 - 1
    assert time.time() - began < limit


def test_many_short_near_alike_texts(spark):
    words = F.array(*[F.lit(f"w{i}") for i in range(10)])
    text = F.array_join(F.transform(words, lambda w, i: F.when(i == F.pmod("id", F.lit(10)), F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(w)), " ")
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    began = time.time()
    assert nd.near_duplicates(docs, 85).where("kept").count() == 100_000
    assert time.time() - began < 240
