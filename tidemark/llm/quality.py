"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 .. G-1. A document's score is a weighted sum of hashed text features; grade k or less has the
probability sigmoid(threshold[k] - score). All grades share the weights, only the ordered thresholds differ. From that come
the expected grade and the tail probability P(grade >= k), by which documents are selected.

Features, hashed to 2**LOG_WIDTH places: words and their beginnings (log counts, scaled down in long texts), the shapes of tokens (runs of letters,
capitals and digits collapsed; as shares of all tokens), the share of tokens that repeat the one before, and the share of
distinct tokens by length of the text. The model is fitted on at most SAMPLE rated documents, those with the smallest hash
of their id (a documented bound); every document is scored on its whole text, tokens over CHUNK bytes as consecutive chunks. Scoring shuffles nothing.

Null and empty texts have no features but that of an empty text. Repeated rows get the same score; an empty table gives an empty
result. Only id and text are read, so extra columns cannot clash; ``select`` hands them on. Without ratings, or with one grade only, the model gives
every document the highest grade that was seen (0 without ratings) and keeps all."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, give_back, held, id_and_text, raw_texts

LOG_WIDTH, SAMPLE, LEAST_DOCS = 20, 6000, 3
CHUNK = 64  # bytes; longer tokens count as consecutive tokens of so many
STEMS = 4, 5  # bytes of a word's beginnings that are features, too
GRADES = 3  # 0: junk, 1: readable but toxic, 2: clean
KEEP_GRADE, KEEP_TAIL = 2, 0.5
_CACHE_MAX = 300_000
_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^\w])\1+"), rb"\1\1"))
_EDGES = b".,;:!?\"'()[]{}*#$%&|-_"


def place(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (1 << LOG_WIDTH) - 1


def token_shape(token: bytes) -> bytes:
    """The token with its runs of letters, capitals, digits and repeated marks collapsed."""
    core, mark = (token[:-1], token[-1:]) if token[-1:] in (b".", b",") else (token, b"")
    if core.isalpha() and core[-1:] != mark:  # the usual case, without regular expressions
        if core.islower():
            return b"a" + mark
        if core[1:].islower():
            return b"Aa" + mark
    for pattern, to in _SHAPES:
        token = pattern.sub(to, token)
    return token


def token_places(token: bytes) -> tuple[int, ...]:
    """Places of a token's shape, its word and the word's beginnings."""
    word = token.lower().strip(_EDGES)
    return place(b"s" + token_shape(token)), place(b"w" + word), *(place(b"p" + word[:n]) for n in STEMS if len(word) > n)


class Featurizer:
    """``wanted``: the places whose features are kept, all if None. Places of short tokens are remembered."""

    def __init__(self, wanted: set[int] | None = None) -> None:
        self.wanted = wanted
        self.known: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def _places(self, token: bytes) -> tuple[int, tuple[int, ...]]:
        shape, *words = token_places(token)
        found = shape, tuple(w for w in words if self.wanted is None or w in self.wanted)
        if len(self.known) < _CACHE_MAX and len(token) < 48:
            self.known[token] = found
        return found

    def __call__(self, text: bytes) -> dict[int, float]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return {place(b"empty"): 1.0}
        counts = Counter(tokens)
        if max(map(len, counts)) > CHUNK:
            tokens = [t[i : i + CHUNK] for t in tokens for i in range(0, len(t), CHUNK)]
            n, counts = len(tokens), Counter(tokens)
        words: dict[int, int] = {}
        shapes: dict[int, int] = {}
        known, find = self.known, self._places
        for token, times in counts.items():
            shape, at = known.get(token) or find(token)
            shapes[shape] = shapes.get(shape, 0) + times
            for w in at:
                words[w] = words.get(w, 0) + times
        scale = 3 / len(counts) ** 0.4
        out = {w: math.log1p(times) * scale for w, times in words.items()}
        repeats = sum(map(eq, tokens, tokens[1:])) / n
        more = [(s, 2 * math.sqrt(times / n)) for s, times in shapes.items()]
        more += (place(b"repeats"), 3 * math.sqrt(repeats)), (place(b"distinct %d %d" % (min(9, 10 * len(counts) // n), min(14, n.bit_length()))), 1.0), (place(b"bias"), 1.0)
        for p, value in more:
            if value and (self.wanted is None or p in self.wanted):
                out[p] = out.get(p, 0.0) + value
        return out


def least_pull(rows: int) -> float:
    """From 2.5 for up to 2000 rows to 4 for 6000 and more: more rows hold more rare features that differ by chance."""
    return min(4.0, max(2.5, 2.5 + 1.5 * math.log(max(rows, 1) / 2000) / math.log(3)))


@dataclass
class OrdinalModel:
    places: np.ndarray  # with a weight, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def key(self) -> bytes:
        return xxhash.xxh3_128_digest(self.places.tobytes() + self.weights.tobytes() + self.thresholds.tobytes())

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. G-1, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(r: np.ndarray, at: np.ndarray, v: np.ndarray, grades: list[int], n_grades: int = GRADES, l2: float = 2e-4, steps: int = 300, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with a small L2 penalty, by Adam over all rows. Row ``r[i]`` has the feature ``at[i]`` with value
    ``v[i]``. Only features in LEAST_DOCS rows or more, whose grades differ from the mean by ``least_pull`` standard errors,
    get a weight."""
    y, n = np.asarray(grades, np.int64), len(grades)
    seen = sorted(set(y.tolist()))
    if len(seen) < 2:
        top = seen[0] if seen else 0
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.where(np.arange(n_grades - 1) < top, -40.0, 40.0))
    df = np.bincount(at, minlength=1 << LOG_WIDTH)
    pull = np.bincount(at, ((y - y.mean()) / y.std())[r], 1 << LOG_WIDTH)
    places = np.flatnonzero((df >= min(LEAST_DOCS, n)) & (np.abs(pull) >= least_pull(n) * np.sqrt(df)))
    if not len(places):
        places = np.flatnonzero(df)
    index = np.full(1 << LOG_WIDTH, -1, np.int32)
    index[places] = np.arange(len(places))
    c = index[at]
    r, c, v = r[c >= 0], c[c >= 0], v[c >= 0].astype(float)
    w = np.zeros(len(places))
    # thresholds start at the grades' shares; gaps stay positive as exponentials
    share = np.clip([(y <= k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    logit = np.log(share / (1 - share))
    t = np.concatenate([[logit[0]], np.log(np.maximum(np.diff(logit), 1e-2))])
    # rare grades weigh more, up to the mean
    balance = np.sqrt(n / (len(seen) * np.bincount(y, minlength=n_grades).clip(1)))[y]
    balance /= balance.mean()
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([[t[0]], np.exp(t[1:])]))
        edges = np.concatenate([[-40.0], cuts, [40.0]])
        score = np.bincount(r, v * w[c], n)
        up = 1 / (1 + np.exp(-np.clip(edges[y + 1] - score, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(edges[y] - score, -40, 40)))
        p = np.maximum(up - lo, 1e-9)
        du, dl = up * (1 - up) / p * balance, lo * (1 - lo) / p * balance
        g_score = (du - dl) / n  # of the negative log likelihood
        g_w = np.bincount(c, v * g_score[r], len(w)) + l2 * w
        g_cut = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / n for k in range(n_grades - 1)])
        g_t = np.array([g_cut.sum(), *(g_cut[k:].sum() * np.exp(t[k]) for k in range(1, n_grades - 1))])
        for x, g, a, b in ((w, g_w, 0, 1), (t, g_t, 2, 3)):
            m[a] = 0.9 * m[a] + 0.1 * g
            m[b] = 0.999 * m[b] + 0.001 * g * g
            x -= rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(m[b] / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(places, w, np.cumsum(np.concatenate([[t[0]], np.exp(t[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels: 0 for low quality, 1 for toxic, 2 for neither. Rows without a label are left out; of
    several labels of a document the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = GRADES, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents. Their ids, at most ``sample`` of them, are broadcast; their features come to the driver.
    Of the rows that repeat a rated id the text with the smallest hash counts, so the driver gets one row an id."""
    chosen = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", F.col("grade").cast("int").alias("grade"))).alias("row"))
    rated = rated.select("doc_id", "row.text", "row.grade")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = held("features", Featurizer)
        rows = [features(t) for t in raw_texts(batch.column(1))]
        kinds = pa.list_(pa.int32()), pa.list_(pa.float32())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array([list(x) for x in rows], kinds[0]), pa.array([list(x.values()) for x in rows], kinds[1])], names=["doc_id", "grade", "at", "value"])

    found = by_batch(rated, run, "doc_id long, grade int, at array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    at, value = found.column("at"), found.column("value")
    rows = np.repeat(np.arange(found.num_rows, dtype=np.int32), pc.list_value_length(at).to_numpy())
    return fit(rows, pc.list_flatten(at).to_numpy(), pc.list_flatten(value).to_numpy(), found.column("grade").to_pylist(), n_grades)


class Scorer:
    def __init__(self, model: OrdinalModel) -> None:
        self.weight = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
        self.features = Featurizer(set(self.weight))

    def __call__(self, text: bytes) -> float:
        return sum(self.weight.get(p, 0.0) * v for p, v in self.features(text).items())


def _judge(model: OrdinalModel, scorer: Scorer, texts: list[bytes], keep_grade: int, keep_tail: float):
    tails = model.grades(np.array([scorer(t) for t in texts]))
    tail = tails[:, keep_grade - 1]
    keep = tail >= keep_tail if len(model.places) else np.ones(len(texts), bool)
    return tails.sum(axis=1), tail, keep


def score(docs: DataFrame, model: OrdinalModel, keep_grade: int = KEEP_GRADE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept): kept is P(grade >= keep_grade) >= keep_tail."""

    def run(batches):
        scorer = held(("scorer", model.key()), lambda: Scorer(model))
        for batch in batches:
            expected, tail, keep = _judge(model, scorer, raw_texts(batch.column(1)), keep_grade, keep_tail)
            yield pa.record_batch([batch.column(0), pa.array(expected), pa.array(tail), pa.array(keep)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def select(docs: DataFrame, model: OrdinalModel, keep_grade: int = KEEP_GRADE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = held(("scorer", model.key()), lambda: Scorer(model))
        for batch in batches:
            yield batch.filter(pa.array(_judge(model, scorer, raw_texts(batch.column(at)), keep_grade, keep_tail)[2]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
