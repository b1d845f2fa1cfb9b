"""Packing token sequences: best fit, then a swap-based local search.

Texts are tokenized where they lie; only (id, piece, start, length, checksum) go on. Documents longer than the capacity are
cut into pieces; full pieces are sequences by themselves. The rest is dealt at random into groups of about GROUP pieces,
and each group is packed in one task, so a group wastes at most part of a sequence. In a group, best fit decreasing
opens bins; then documents are moved, exchanged one for one or two for one from an underfull bin to one at least as full, always
so that the sum of squared fills grows, until a pass over all bins finds no such step; bins that run empty are gone.

Null and empty texts are one end-of-document token. Every row is packed, also repeated ones and ones without an id; an empty table
gives an empty result. Texts of any length are packed whole. Extra columns are not read, so they cannot clash."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, held, id_and_text, raw_texts
from tidemark.session import cut

CAPACITY, GROUP, CACHE_MAX = 2048, 16_384, 300_000
END = bytes(4)  # id 0, after each document


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and cut texts there, so that the ids of a text are those of its chunks between
    ASCII blanks one after the other. Ids of short chunks are remembered, at most CACHE_MAX; the unknown chunks of some
    texts are encoded in one call, with SEPARATOR between them where the tokenizer has one id for it. Chunks of letters alone need
    none: each is one run, whose last id, and no other, is of a token that ends a word."""

    WORD_END = "</w>"
    SEPARATOR, AT_ONCE = "\x01", 2 << 20  # bytes of text whose unknown chunks are encoded together

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(f" {self.SEPARATOR} ", add_special_tokens=False).ids
        self.separator_id = mark[0] if len(mark) == 1 else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        # only if every byte may end a word there is such an id for each run
        self.by_ends = sum(len(token) == len(self.WORD_END) + 1 and token.endswith(self.WORD_END) for token in vocabulary) == 256
        self.marks = dict(zip((b".", b","), self._encode([b".", b","]), strict=True))

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        letters = [i for i, text in enumerate(texts) if text.isalpha()] if self.by_ends else []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in letters])], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(letters):  # some letter is none to the tokenizer
            return self._apart(texts)
        raw, out = ids.tobytes(), [b""] * len(texts)
        for i, a, b in zip(letters, [0, *ends], ends, strict=False):
            out[i] = raw[4 * a : 4 * b]
        others = [i for i, text in enumerate(texts) if not text.isalpha()] if self.by_ends else range(len(texts))
        for i, found in zip(others, self._apart([texts[i] for i in others]), strict=True):
            out[i] = found
        return out

    def _apart(self, texts: list[str]) -> list[bytes]:
        """Ids of chunks of any kind."""
        joined = f" {self.SEPARATOR} ".join(texts)
        if self.separator_id is not None and joined.count(self.SEPARATOR) == len(texts) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.separator_id).tolist(), len(ids)]
            if len(ends) == len(texts):
                raw = ids.tobytes()
                return [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not known, of which some are remembered, if they are not too many or too long. A full stop or comma
        after a letter is always a token run of its own, so such chunks are put together from their two parts."""
        known, marks = self.known, self.marks
        cores = {c: c[:-1] if c[-1:] in marks and c[-2:-1].isalpha() else c for c in chunks}
        new = list({core for core in cores.values() if core not in known})
        found = dict(zip(new, self._encode(new), strict=True))
        for c, core in cores.items():
            if core is not c:
                found[c] = (found.get(core) or known[core]) + marks[c[-1:]]
        if (room := CACHE_MAX - len(known)) > 0:
            known.update(islice(((c, ids) for c, ids in found.items() if len(c) < 64), room))
        return found

    def _some(self, texts: list[bytes]) -> Iterator[bytes]:
        # ids do not depend on case, but for the names of special tokens
        read, missing, get = [], set(), self.known.get
        for text in texts:
            chunks = (text if b"<|" in text else text.lower()).split()
            ids = list(map(get, chunks))
            at = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            lacking = [chunks[i] for i in at]
            missing.update(lacking)
            read.append((ids, at, lacking))
        found = self._learn(missing) if missing else {}
        for ids, at, lacking in read:
            for i, c in zip(at, lacking, strict=True):
                ids[i] = found[c]
            ids.append(END)
            yield b"".join(ids)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.AT_ONCE:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, with the end id, cut at the capacity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: tuple[list, ...] = ([], [], [], [], [])
        for doc, ids in zip(batch.column(0).to_pylist(), held(("ids", tokenizer), lambda: Ids(tokenizer))(raw_texts(batch.column(1))), strict=True):
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, value in zip(columns, (doc, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_batch(id_and_text(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of positions."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fitting := rooms >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search. Takes underfull bins, the emptiest first, and pushes their contents into bins at least as full: it moves
    a document where there is room, else gives one document for a smaller one, or two for one smaller than both together,
    so that the fuller bin becomes fuller. Each step adds to the sum of squared fills. All bins, partners and pairs count, and the
    search ends when a pass over all underfull bins finds no step."""
    size = np.asarray(lengths, np.int64)
    bins = [list(b) for b in bins]
    fill = np.array([size[b].sum() for b in bins], np.int64)
    # full bins cannot be filled further and never take part again; documents of the others, and where they lie
    docs = np.array([i for b, f in zip(bins, fill, strict=True) if f < capacity for i in b], np.int64)
    home = np.array([b for b, f in enumerate(fill) if f < capacity for _ in bins[b]], np.int64)
    slot, long = {int(i): n for n, i in enumerate(docs)}, size[docs]

    def put(i: int, a: int, b: int) -> None:
        bins[a].remove(i)
        bins[b].append(i)
        home[slot[i]] = b
        fill[a] -= lengths[i]
        fill[b] += lengths[i]

    def step(a: int) -> bool:
        """One improving step from bin a to a bin at least as full, if there is any."""
        room = capacity - fill[home]
        theirs = np.flatnonzero((fill[home] >= fill[a]) & (room > 0) & (home != a))
        if not len(theirs):
            return False
        room, there = room[theirs], long[theirs]
        mine = size[bins[a]]
        if len(fits := np.flatnonzero(room >= mine.min())):
            to = fits[room[fits].argmin()]  # the fullest bin that a document fits in takes the largest that fits
            put(max((i for i in bins[a] if lengths[i] <= room[to]), key=lambda i: (lengths[i], -i)), a, int(home[theirs[to]]))
            return True
        # a document of length n in a bin with room r can go for documents of n + 1 to n + r together
        upto = np.zeros(2 * capacity + 1, np.int64)
        np.maximum.at(upto, there + 1, there + room)
        upto = np.maximum.accumulate(upto)
        once, count = np.unique(mine, return_counts=True)
        first, second = np.triu_indices(len(once))
        ok = (first != second) | (count[first] > 1)
        first, second = first[ok], second[ok]
        for totals in (once, once[first] + once[second]):
            good = np.flatnonzero(upto[totals] >= totals)
            if not len(good):
                continue
            pick = good[totals[good].argmax()]
            total = int(totals[pick])
            can = np.flatnonzero((there < total) & (there + room >= total))
            take = can[np.lexsort((theirs[can], there[can], room[can]))[0]]  # from the fullest bin, its smallest
            sizes = [int(once[pick])] if totals is once else [int(once[first[pick]]), int(once[second[pick]])]
            give: list[int] = []
            for n in sizes:
                give.append(next(i for i in bins[a] if lengths[i] == n and i not in give))
            i, b = int(docs[theirs[take]]), int(home[theirs[take]])
            for g in give:
                put(g, a, b)
            put(i, b, a)
            return True
        return False

    changed = True
    while changed:
        changed = False
        for a in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            while bins[a] and fill[a] < capacity and step(a):
                changed = True
    return [sorted(b, key=lambda i: (lengths[i], i)) for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece lies. Sequences that are one full piece
    have negative numbers, the others number their group and bin."""
    found = cut(pieces(docs, tokenizer, capacity).withColumn("_row", F.monotonically_increasing_id()))
    full = found.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(groups)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("_row", "ascending")])
        lengths = table.column("length").to_pylist()
        sequence, offset, base = [0] * len(lengths), [0] * len(lengths), key[0].as_py() << 32
        for number, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i], at = base + number, at, at + lengths[i]
        return pa.table([*(table.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    packed = dealt.select("_group", *names, "_row").groupBy("_group").applyInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(full)
