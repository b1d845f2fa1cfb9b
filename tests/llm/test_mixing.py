import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import mixing


def test_targets():
    assert mixing.targets([], (1, 2, 3)) == []
    assert mixing.targets([100, 100, 100]) == pytest.approx([50, 100, 150])
    assert mixing.targets([1000, 10, 10]) == pytest.approx([960, 30, 30])  # both capped, the rest goes to the first
    assert mixing.targets([0, 5]) == pytest.approx([0, 5])
    many = mixing.targets([1, 50, 3, 900, 2, 44])
    assert sum(many) == pytest.approx(1000) and all(t <= 3 * s + 1e-9 for t, s in zip(many, [1, 50, 3, 900, 2, 44], strict=True))


def test_quotas_are_exact_and_even():
    quotas = [13, 0, 200, 7, 1]
    m = mixing.split_quotas(quotas, 5, seed=3)
    assert m.sum(axis=0).tolist() == quotas and np.ptp(m.sum(axis=1)) <= 3 and (m >= 0).all()
    assert (m == mixing.split_quotas(quotas, 5, seed=3)).all() and (m != mixing.split_quotas(quotas, 5, seed=4)).any()


def test_draws_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.draw(docs).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in text.items()}
    sources = sorted({r["source"] for r in text.values()}, key=lambda s: s.encode())
    totals = [sum(size[i] for i, r in text.items() if r["source"] == s) for s in sources]
    goal = dict(zip(sources, mixing.targets(totals), strict=True))
    taken, most = defaultdict(int), defaultdict(int)
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        s = text[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["target"] == pytest.approx(goal[s]) and 0 <= r["copies"] <= 3 and len(set(range(r["copies"])) - set(range(len(r["shards"])))) == 0
        taken[s] += r["copies"] * r["size"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1 for s in sources)  # half a document at most
    assert sorted(map(str, rows)) == sorted(map(str, mixing.draw(docs.repartition(7)).collect()))


def test_mixed_rows(spark, odd_docs, no_docs):
    copies = [r["copies"] for r in mixing.draw(odd_docs, n_shards=3).collect()]
    mixed = mixing.mix(odd_docs, n_shards=3)
    assert mixed.columns == [*odd_docs.columns, "_shard", "_place"]
    assert {r["_shard"] for r in mixed.collect()} <= {0, 1, 2}
    assert mixed.count() == sum(copies)
    assert mixing.mix(no_docs).count() == 0 and mixing.draw(no_docs).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.draw(odd_docs, max_sources=2)


def h(*values, seed=42):
    """xxhash64 over columns; str: text, int: long, (int,): int."""
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_draw(rows, n_shards, weights, seed):
    """copies and shards of each row, by plain loops over sources, blocks and documents."""
    key = lambda s: "1" if s is None else "0" + s.encode().hex().upper()
    seen, docs = Counter(), []
    for doc, text, source in rows:
        same = doc, h(text), key(source)
        docs.append([*same, seen[same], len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))])
        seen[same] += 1
    sources = sorted({d[2] for d in docs})
    goal = mixing.targets([sum(d[4] for d in docs if d[2] == s) for s in sources], weights)
    out, quotas, runs = [], [], {}
    for s, target in zip(sources, goal, strict=True):
        mine = sorted((h(d[0], d[1], d[3], (seed,)), d) for d in docs if d[2] == s)
        total, n_blocks = sum(d[4] for _, d in mine), math.isqrt(len(mine) - 1) + 1
        whole = int(target // total) if total else 0
        blocks = defaultdict(list)
        for x, d in mine:
            blocks[h(x, "block") % n_blocks].append((x, d))
        left, quota = target - whole * total, 0
        for position, b in enumerate(sorted(blocks, key=lambda b: (h(s, b, (seed,)), b))):
            words = sum(d[4] for _, d in blocks[b])
            room, left, upto = left, left - words, 0
            quota += room > 0
            for x, d in blocks[b]:
                upto += d[4]
                extra = room > 0 and (room >= words or upto - d[4] / 2 <= room)
                runs[tuple(d)] = s, [p * n_blocks + position for p in range(whole + extra if total else 0)]
        quotas.append(whole * n_blocks + quota)
    ends = dict(zip(sources, np.cumsum(mixing.split_quotas(quotas, n_shards, seed), axis=0).T.tolist(), strict=True))
    for d, (s, numbers) in runs.items():
        out.append((d[0], d[1], d[3], [min(sum(e <= k for e in ends[s]), n_shards - 1) for k in numbers]))
    return sorted(map(str, out))


def drawn_rows(df, **options):
    return sorted(str((r["doc_id"], r["_key"], r["_copy"], r["shards"][: r["copies"]])) for r in mixing.draw(df, **options).collect())


@pytest.mark.parametrize("seed", [0, 7])
def test_against_a_plain_draw(spark, odd_docs, seed):
    rng = random.Random(seed)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()] + [(1000 + i, "w " * rng.randrange(1, 60), rng.choice(["s0", "t"])) for i in range(300)]
    rows += [(7, "a copy of one row", "s1")] * 60 + [(None, None, "u")] * 20 + [(None, "no id here", "s0")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert drawn_rows(df, n_shards=5, seed=seed) == brute_draw(rows, 5, (1, 2, 3), seed)
    copies = Counter()
    for r in mixing.draw(df, n_shards=5, seed=seed).collect():
        copies[r["doc_id"], r["_key"]] += r["copies"]
    assert Counter((r["doc_id"], h(r["text"])) for r in mixing.mix(df, n_shards=5, seed=seed).collect()) == Counter({k: n for k, n in copies.items() if n})


def test_the_tree_deals_copies_and_never_changes_totals(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    took = lambda rows: {r["doc_id"]: r["copies"] for r in rows}
    plain = mixing.draw(docs).collect()
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, n, seed: split(quotas, n, seed + 99))
    other = mixing.draw(docs).collect()
    assert took(plain) == took(other) and {r["doc_id"]: r["shards"] for r in plain} != {r["doc_id"]: r["shards"] for r in other}
