"""The pipeline on nulls, repeated rows, clashing columns and empty tables, each stage against a plain version of it."""

import math
import os
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import line_dedup, mixing, quality
from tidemark.llm.queries import tokenizer_path
from tidemark.session import ensure_shared_dir


def words(text):
    return (text or "").encode().split()


def grade_of(model, text):
    """P(grade >= 2) from a plain loop over the features."""
    weight = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    score = sum(weight.get(p, 0.0) * v for p, v in quality.Featurizer()((text or "").encode()).items())
    return 1 / (1 + math.exp(max(-40, min(40, model.thresholds[1] - score))))


def plain_lines(rows):
    holders = {}
    for r in rows:
        for k in {line_dedup.line_key(x.encode()) for x in (r["text"] or "").split("\n")} - {None}:
            if r["doc_id"] is not None:
                holders.setdefault(k, set()).add(r["doc_id"])
    gone = lambda d, x: (k := line_dedup.line_key(x.encode())) and len(holders.get(k, ())) >= 5 and max(holders[k]) != d
    return [(r["doc_id"], r["source"], r["text"] and "\n".join(x for x in r["text"].split("\n") if not gone(r["doc_id"], x))) for r in rows]


def plain_near(rows):
    sets, up = [], {}
    for r in rows:
        w = [x.lower() for x in words(r["text"])]
        sets.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
        up[r["doc_id"]] = r["doc_id"]
    root = lambda x: x if up[x] == x else root(up[x])
    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if None not in (a, b) and s & t and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return [tuple(r) for r in rows if r["doc_id"] is None or root(r["doc_id"]) == r["doc_id"]]


def check_mix(before, after):
    own = lambda r: str(tuple(r))
    source = lambda r: (r["source"] is None, (r["source"] or "").encode())
    size, most, got = Counter(), Counter(), Counter()
    for r in before:
        n = len(words(r["text"]))
        size[source(r)] += n
        most[source(r)] = max(most[source(r)], n)
    for r in after:
        got[source(r)] += len(words(r["text"]))
    names = sorted(size)
    for name, goal in zip(names, mixing.targets([size[n] for n in names]), strict=True):
        assert abs(got[name] - goal) <= most[name] / 2 + 1e-6, name
    there, taken = Counter(map(own, before)), Counter(map(own, after))
    assert all(taken[r] <= 3 * there[r] for r in taken)


def check_pack(before, after):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + 2048]))) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(str(tuple(r)[:5]) for r in after) == sorted(map(str, want))
    filled = {}
    for r in after:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        ends = [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts) + 1)]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    lengths = sorted((w[3] for w in want), reverse=True)
    room = []  # first fit decreasing
    for n in lengths:
        k = next((k for k, free in enumerate(room) if free >= n), None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    assert len(filled) <= len(room)


def written(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def labelled(spark, odd_docs):
    import random

    rng = random.Random(9)
    junk = [(1000 + i, " ".join("$%d#" % rng.randrange(99) for _ in range(60)), f"s{i % 3}") for i in range(20)]
    extra = odd_docs.columns[3:]
    more = spark.createDataFrame([(*r, *([None] * len(extra))) for r in junk + [(2000 + i, prose(rng, 80), "s1") for i in range(20)]], odd_docs.schema)
    labels = [(1000 + i, 0, 0, "?") for i in range(16)] + [(2000 + i, 1, 0, "?") for i in range(20)] + [(i, 1, None, None) for i in range(20)]
    return odd_docs.unionByName(more), labels + [(None, 0, 1, None), (5, None, 1, None), (51, 1, 0, None), (80, 1, 0, None), (1000, 0, 0, "?"), (999_999, 0, 0, "?")]


def test_stages_against_plain_versions(spark, labelled, tmp_path):
    docs, labels = labelled
    sf = written(spark, tmp_path, docs, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, first = docs.collect(), docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        same = lambda got, want: sorted(map(str, got)) == sorted(map(str, want))
        if name != "pack":
            assert docs.columns == columns and docs.schema.simpleString() == first.schema.simpleString()
        if name == "quality":
            model = quality.train(first, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
            assert same(map(tuple, after), [tuple(r) for r in before if grade_of(model, r["text"]) >= 0.5])
            ids = {r["doc_id"] for r in after}
            assert not ids & set(range(1000, 1020)) and set(range(2000, 2020)) <= ids
        if name == "lines":
            assert same([(r["doc_id"], r["source"], r["text"]) for r in after], plain_lines(before)) and len({r["doc_id"] for r in before if r["doc_id"] is not None}) > 50
        if name == "near":
            assert same(map(tuple, after), plain_near(before)) and len(after) < len(before)
        if name == "mix":
            check_mix(before, after)
        if name == "pack":
            check_pack(before, after)


def test_mix_and_pack_of_whole_documents(spark):
    """The last two stages on documents of the given tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    rows = mixed.collect()
    check_mix(docs.collect(), rows)
    whole = spark.createDataFrame(rows, mixed.schema)
    check_pack(rows, corpus_pipeline.pack_sequences(spark, whole, "").collect())


@pytest.mark.parametrize("case", ["no documents", "no labels", "nothing"])
def test_empty_tables(spark, labelled, tmp_path, case):
    docs, labels = labelled
    sf = written(spark, tmp_path, docs if case == "no labels" else docs.where("false"), [] if case != "no documents" else labels)
    out = corpus_pipeline.run(spark, sf)
    assert (out.count() > 0) == (case == "no labels") and out.columns[:2] == ["doc_id", "piece"]


def test_a_failed_run_goes_on(spark, labelled, tmp_path, monkeypatch):
    docs, labels = labelled
    sf, folder, calls = written(spark, tmp_path / "in", docs, labels), str(tmp_path / "stages"), []

    def counted(name, stage, fails=False):
        def call(*args):
            calls.append(name)
            if fails:
                raise OSError("lost")
            return stage(*args)

        return name, call

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s, fails=s[0] == "near") for s in stages])
    with pytest.raises(OSError, match="lost"):
        corpus_pipeline.run(spark, sf, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in stages])
    again = corpus_pipeline.run(spark, sf, folder)
    assert calls == ["quality", "lines", "near", "near", "mix", "pack"] and again.count() > 0
    monkeypatch.undo()
    before = set(os.listdir(ensure_shared_dir(spark).removeprefix("file:")))
    fresh = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, fresh.drop("sequence_id").select(*again.columns[:5]).collect())) == sorted(map(str, again.select(*again.columns[:5]).collect()))
    (new,) = [d for d in set(os.listdir(ensure_shared_dir(spark).removeprefix("file:"))) - before if d.startswith("pipeline-")]
    assert os.listdir(f"{ensure_shared_dir(spark).removeprefix('file:')}/{new}") == ["pack"]
