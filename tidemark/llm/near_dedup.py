"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles, each shingle one 64-bit hash. Documents with equal sets form a class; from
   here on only classes are compared, so exact copies are never paired.
2. A set's K smallest hashes are its sketch. INDEXED of them are filed in inverted lists. Of two sets as alike as asked,
   NEED at least share so many filed values but for a chance below MISS, so each set is filed only under its rarest
   ``INDEXED - NEED + 1`` values: values that occur once find nobody, and those of passages that everyone quotes are not used.
3. Sets that share a list meet in one group, or if that is too heavy for a task, in its single lists; heavy groups and lists
   are cut into blocks and each pair of blocks is one task. So every pair that shares a list meets, and no task
   holds more than about two blocks. A set of a group of b blocks is sent to b tasks.
4. In a task, inverted lists of sketch values find pairs and count overlaps; pairs that pass go through the union-sketch
   estimate, and the rest is confirmed on the full sets. Pairs that are already connected are skipped, so links out of a task
   are a forest and not all pairs.
5. Components of the links are found by star contraction.

Chances: two different shingles share a 64-bit hash with 2**-64; a pair at the threshold is lost in 2 or 4 with about
1e-7 and 1e-8. Rows with the same id count as one document. Rows with a null id are copied through with
``component_id`` null and kept. Null, empty and blank texts have no shingles and link with nothing. Texts of any length are
taken whole. Repeated rows give repeated results; an empty table gives an empty one. Only id and text are read, so other
columns, whatever their names, cannot clash; ``keep_one`` hands them on."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, free_names, give_back, held, id_and_text, raw_texts
from tidemark.llm.graph import components
from tidemark.session import cut

WORDS = 5
K, INDEXED, MISS = 64, 16, 1e-7
BLOCK = 1_000_000  # shingles in a block: 8 MB
SET_COST = 64  # a set weighs as much as so many shingles at least, so a block holds BLOCK / SET_COST sets at most, about
GIVE_FROM = 8 << 20  # bytes of a group's sets from which their memory is given back at once
LISTS_FROM = 32  # groups of more blocks than this are taken list by list
_CACHE_MAX = 300_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word. Frequent words are remembered, at most _CACHE_MAX of them."""
    known = held("word hashes", dict)
    out = list(map(known.get, words))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = h = xxhash.xxh3_64_intdigest(words[i])
                if len(known) < _CACHE_MAX and len(words[i]) < 64:
                    known[words[i]] = h
    return np.array(out, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles. A-Z are lower-cased; bytes.split cuts at the six ASCII blanks."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = word_hashes(found)
    n = max(1, len(h) - words + 1)
    width = min(words, len(h))
    acc = np.full(n, np.uint64(width))
    for i in range(width):
        acc = _mix((acc + h[i : i + n]) * _STEP[i % len(_STEP)] + np.uint64(i))
    return np.unique(acc)


def set_digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def at_least(n: int, share: float, miss: float = MISS) -> int:
    """The largest m for which fewer than m successes in n trials have a chance of at most ``miss``."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n, m) * share**m * (1 - share) ** (n - m)
        if total > miss:
            return max(1, m)
    return n


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, digest, filed): size, 128-bit digest and INDEXED smallest hashes of each document's set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in raw_texts(batch.column(1))]
        filed = [x[:INDEXED].view(np.int64) for x in found]
        offsets = np.cumsum([0, *map(len, filed)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(filed)))
        return pa.record_batch([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([set_digest(x) for x in found], pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "filed"])

    return by_batch(id_and_text(docs), run, "doc_id long, n_shingles long, digest binary, filed array<long>")


class _Labels:
    """Components of the links found so far; the smaller one takes the label of the larger."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> None:
        a, b = sorted((int(self.of[a]), int(self.of[b])), key=lambda x: len(self.members[x]))
        self.of[self.members[a]] = b
        self.members[b] += self.members.pop(a)


class _Sketches:
    """Sketches of sorted hash sets. ``rows``: the places of each sketch's values among all values of the task, ascending, filled up
    with ``none``. ``owner`` and ``value``: the inverted lists, values numbered from the rarest of the task to the most frequent."""

    def __init__(self, values: list[np.ndarray], side: np.ndarray, percent: int) -> None:
        self.values, self.side, self.percent = values, side, percent
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.low = at_least(K, percent / 100)
        n, lengths = len(values), np.minimum(self.sizes, K)
        distinct, at, count = np.unique(np.concatenate([v[:K] for v in values]), return_inverse=True, return_counts=True)
        self.none = len(distinct)
        number = np.empty(self.none, np.int64)
        number[np.lexsort((distinct, count))] = np.arange(self.none)
        owner, numbers = np.repeat(np.arange(n), lengths), number[at]
        column = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.rows = np.full((n, K), self.none, np.int32)
        self.rows[owner, column] = at
        self.hit, self.place = np.zeros(self.none + 1, bool), np.zeros(self.none + 1, np.int32)
        self.full: tuple | None = None
        numbers = numbers[np.lexsort((numbers, owner))]
        # how many sketch values a set shares at least with any that it can be linked with; the rarest others are enough to meet
        least = -(-percent * self.sizes // 100)
        least = np.where(100 * self.sizes // percent <= K, least, np.where(least >= K, self.low, np.ceil(least * (self.low / K)))).astype(np.int64)
        filed = (column < np.repeat(lengths - least + 1, lengths)) & (np.sort(count)[numbers] > 1)
        order = np.lexsort((owner[filed], numbers[filed]))
        self.owner, self.value = owner[filed][order], numbers[filed][order]  # inverted lists, one after the other

    def fits(self, x, y, counts: np.ndarray) -> np.ndarray:
        """Which pairs with so many common sketch values can be linked; where both sketches are whole sets, which are."""
        a, b = self.sizes[x], self.sizes[y]
        small, large = np.minimum(a, b), np.maximum(a, b)
        enough = np.where(large <= K, 100 * counts >= self.percent * (a + b - counts), counts >= np.where(small >= K, self.low, np.ceil(small * (self.low / K))))
        return enough & (100 * small >= self.percent * large) & (counts > 0)

    def mark(self, x: int, on: bool) -> None:
        """Notes x as the set that others are compared with, or takes that back."""
        mine = self.rows[x, : min(K, self.sizes[x])]
        self.hit[mine] = on
        self.place[mine] = np.arange(len(mine))

    def linked(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Which of ``ys`` are linked with the marked set x; all fit. By the union-sketch estimate, then on the full sets."""
        small, large = np.minimum(self.sizes[x], self.sizes[ys]), np.maximum(self.sizes[x], self.sizes[ys])
        out = large <= K
        check = ~out
        if (sketched := small >= K).any():
            # a common value that is number t of them, at places p and q, is number p + q - t of the union: among its K smallest?
            rows = self.rows[ys]
            both = self.hit[rows]
            near = np.arange(K) + self.place[rows] - np.cumsum(both, axis=1) + 1 < K
            check &= ~sketched | ((both & near).sum(axis=1) >= self.low)
        if (at := np.flatnonzero(check)).size:
            if self.full is None:
                distinct, places = np.unique(np.concatenate(self.values), return_inverse=True)
                self.full = places.astype(np.int32), np.concatenate([[0], np.cumsum(self.sizes)]), np.zeros(len(distinct), bool)
            places, begin, hit = self.full
            mine = places[begin[x] : begin[x + 1]]
            hit[mine] = True
            theirs = [places[begin[y] : begin[y + 1]] for y in ys[at].tolist()]
            both = np.add.reduceat(hit[np.concatenate(theirs)], np.cumsum([0, *map(len, theirs[:-1])]), dtype=np.int64)
            hit[mine] = False
            out[at] = 100 * both >= self.percent * (self.sizes[x] + self.sizes[ys[at]] - both)
        return out

    def overlaps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common sketch values of each pair."""
        out = []
        for i in range(0, len(x), 8192):
            a, b = self.rows[x[i : i + 8192]], self.rows[y[i : i + 8192]]
            both = np.sort(np.concatenate([np.where(a == self.none, -1 - np.arange(K), a), np.where(b == self.none, -1 - K - np.arange(K), b)], axis=1), axis=1)
            out.append((both[:, 1:] == both[:, :-1]).sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def links_among(values: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted hash sets: all pairs if ``side`` is constant, else pairs across sides.

    Sets meet in inverted lists of the rarest values of their sketches, enough of them that linked sets meet. First each set
    is compared with its neighbour in its rarest and in its most frequent list, which connects families of near copies. Then
    only lists that still hold several components are gone through, and in them only sets of other components. A pair whose
    union-sketch estimate is far off is not compared in full."""
    n = len(values)
    if n < 2:
        return []
    across = side.min() != side.max()
    s, labels, out = _Sketches(values, side, percent), _Labels(n), []
    owner, value = s.owner, s.value

    def settle(x: int, ys: np.ndarray, counts: np.ndarray) -> None:
        """Links x, which is marked, to sets of other components, the most alike ones first."""
        fit = s.fits(x, ys, counts) & ((side[x] != side[ys]) | (not across))
        ys = ys[fit][np.argsort(-counts[fit], kind="stable")]
        size = 16
        while len(ys := ys[labels.of[ys] != labels.of[x]]):
            some, ys, size = ys[:size], ys[size:], min(4096, 4 * size)
            for y in some[s.linked(x, some)].tolist():
                if labels.of[x] != labels.of[y]:
                    labels.join(x, y)
                    out.append((x, y))

    after = np.flatnonzero(value[1:] == value[:-1]) + 1  # entries with a neighbour before them in their list
    by_set = after[np.argsort(owner[after], kind="stable")]  # ascending by value inside a set
    first = np.flatnonzero(np.diff(owner[by_set], prepend=-1))
    last = np.flatnonzero(np.diff(owner[by_set], append=-1))
    near = by_set[np.unique(np.concatenate([first, last]))]
    x, y = owner[near], owner[near - 1]
    counts = s.overlaps(x, y)
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    for a, b in zip(starts.tolist(), np.append(starts, len(x))[1:].tolist(), strict=True):
        s.mark(x[a], True)
        settle(int(x[a]), y[a:b], counts[a:b])
        s.mark(x[a], False)

    if len(value):
        starts = np.flatnonzero(np.diff(value, prepend=-1))
        open_ = np.minimum.reduceat(labels.of[owner], starts) != np.maximum.reduceat(labels.of[owner], starts)
        if across:
            open_ &= np.minimum.reduceat(side[owner], starts) != np.maximum.reduceat(side[owner], starts)
        of_list = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(value))))
        entries = np.flatnonzero(open_[of_list] & (starts[of_list] < np.arange(len(value))))
        entries = entries[np.argsort(owner[entries], kind="stable")]
        cuts = np.flatnonzero(np.diff(owner[entries], prepend=-1))
        seen = np.zeros(n, bool)
        for mine in np.split(entries, cuts[1:]) if len(entries) else []:
            x = int(owner[mine[0]])
            for a, b in zip(starts[of_list[mine]].tolist(), mine.tolist(), strict=True):
                seen[owner[a:b]] = True
            found = np.flatnonzero(seen[:x])
            seen[found] = False
            found = found[labels.of[found] != labels.of[x]]
            if across:
                found = found[side[found] != side[x]]
            if len(found):
                s.mark(x, True)
                settle(x, found, s.hit[s.rows[found]].sum(axis=1))
                s.mark(x, False)
    return out


def candidate_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n_shingles): under which of its filed values each class is found, values with one class left out."""
    need = at_least(INDEXED, percent / 100)
    filed = classes.select("rep", "n_shingles", F.size("filed").alias("r"), F.explode("filed").alias("value"))
    shared = cut(filed.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))  # stored: the join can then split hot values
    met = filed.join(shared, "value").groupBy("rep", "n_shingles", "r").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("met"))  # at most INDEXED a class
    # rarest first; the values that occur once are the very rarest and take up their part of the prefix
    prefix = F.size("met") - F.ceil(F.col("r") * (need / INDEXED)) + 1
    rare = met.where(prefix > 0).select("rep", "n_shingles", F.explode(F.slice("met", 1, prefix.cast("int"))).alias("m"))
    return rare.select(F.col("m.value").alias("value"), "rep", "n_shingles")


def _weight() -> Column:
    return F.greatest(F.col("n_shingles"), F.lit(SET_COST))


def class_links(docs: DataFrame, classes: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """(a, b): links between class representatives, enough of them to connect all that the full sets connect."""
    lists = cut(candidate_lists(classes, percent))
    starts = cut(lists.groupBy("value").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    stars = lists.join(starts, "value").select("value", "rep", "n_shingles", "pivot")
    groups = components(stars.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    members = cut(groups.join(classes.select(F.col("rep").alias("node"), "n_shingles", "digest"), "node"))
    heavy = members.groupBy("component").agg(F.sum(_weight()).alias("weight"))
    # at most one such group for each LISTS_FROM * BLOCK shingles of the corpus: 600,000 ids of 8 bytes for 100 TB of text
    many = F.broadcast(heavy.where(F.col("weight") > LISTS_FROM * BLOCK).select("component"))
    # groups that fit are taken whole, the others list by list; both in blocks
    whole = members.join(many, "component", "left_anti").select(F.col("component").alias("grp"), F.lit(None).cast("long").alias("value"), "node", "n_shingles")
    single = members.join(many, "component", "left_semi").join(stars.select(F.col("rep").alias("node"), "value"), "node").select(F.col("component").alias("grp"), "value", "node", "n_shingles")
    placed = whole.unionByName(single)
    weights = cut(placed.groupBy("grp", "value").agg(F.ceil(F.sum(_weight()) / BLOCK).cast("int").alias("blocks"))).withColumnsRenamed({"grp": "_grp", "value": "_value"})
    placed = placed.join(weights, (F.col("grp") == F.col("_grp")) & F.col("value").eqNullSafe(F.col("_value"))).select("grp", "value", "node", "blocks")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = pairs.select("node", F.xxhash64("grp", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"))
    wanted = members.select(F.col("node").alias("doc_id"), "digest")
    # full sets of the classes that met anyone; texts come along once
    texts = id_and_text(docs).join(wanted, "doc_id")

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in raw_texts(batch.column(1))]
        mask = pa.array([set_digest(x) == d for x, d in zip(found, batch.column(2).to_pylist(), strict=True)])  # an id may occur with other texts
        return pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "hashes"]).filter(mask)

    hashes = by_batch(texts.select("doc_id", "text", "digest"), full, "node long, hashes binary")
    dealt = tasks.join(hashes, "node")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: OrderedDict[tuple[int, bytes], int] = OrderedDict()
        for batch in batches:
            for node, side, raw in zip(batch.column("node").to_pylist(), batch.column("side").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                found[node, raw] = side
        rows = sorted(found.items(), key=lambda r: (r[0][0], len(r[0][1])))
        values = [np.frombuffer(raw, np.uint64) for (_, raw), _ in rows]
        links = links_among(values, np.array([side for _, side in rows]), percent)
        yield pa.record_batch([pa.array([rows[x][0][0] for x, _ in links], pa.int64()), pa.array([rows[y][0][0] for _, y in links], pa.int64())], names=["a", "b"])
        size = sum(len(raw) for _, raw in found)
        del found, rows, values
        if size >= GIVE_FROM:
            give_back()

    return dealt.select("task", "side", "node", "hashes").groupBy("task").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``. Documents are linked if
    100 * |common shingles| >= percent * |all shingles|; a component is named by its smallest doc_id, which is kept."""
    own = cut(sets(docs, words))
    some = own.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep"), F.first("filed").alias("filed")))
    # an id with several texts is one document: its classes are linked through the id
    twins = some.select("doc_id", "n_shingles", "digest").join(classes.select("n_shingles", "digest", "rep"), ["n_shingles", "digest"])
    links = class_links(docs, classes, percent, words)
    through_id = twins.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1).select("a", F.explode("reps").alias("b"))
    found = components(links.unionByName(through_id))
    by_class = classes.select("n_shingles", "digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("n_shingles", "digest", F.coalesce("component", "rep").alias("component"))
    out = own.drop("filed").join(by_class, ["n_shingles", "digest"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are near copies of one that stays. Of rows that repeat the
    kept id all stay."""
    (name,) = free_names(docs, "_gone")
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
