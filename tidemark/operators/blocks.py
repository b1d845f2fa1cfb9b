"""Chains of two large sets of pairs whose words are nearly empty, as products of bit matrices in blocks.

Where the values of a word have little to do with each other, joined words stand for one or two pairs each, and there are as many of them as
plain joined rows. Here the first values are dealt over blocks, the words of the last values as well, and for each pair of blocks one task
takes the pairs of the one and of the other: for each first value it puts the bit rows of its middle values together. So joined rows are neither
made nor shuffled; each pair is sent once for each block of the other side, as sorted numbers of which only the packed steps are sent. Each word of the result is
made by one task. With a mask only pairs that it holds are given."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 4_000_000  # pairs of either side in a task
DENSE_MB = 64  # of bit rows at a time
AT_ONCE = 2048  # bit rows put together at a time
_SENT = "_cell int, _side int, _size long, _data binary"


def _dealt(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _written(values: np.ndarray, fine: np.ndarray) -> bytes:
    """Pairs in order, as steps of the first value and of the second one (from nothing where the first one steps)."""
    order = np.lexsort((fine, values))
    a, b = values[order], fine[order]
    steps = np.diff(a, prepend=0)
    after = np.where(steps != 0, b, np.diff(b, prepend=0))
    if len(b):
        after[0] = b[0]
    parts = []
    for x in (steps, after):
        kind = next(k for k in (np.int16, np.int32, np.int64) if not len(x) or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
        parts.append(np.array([np.dtype(kind).itemsize], np.uint8).tobytes() + x.astype(kind).tobytes())
    return len(parts[0]).to_bytes(8, "little") + b"".join(parts)


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    first, second = data[8 : 8 + n], data[8 + n :]
    steps, after = (np.frombuffer(p, f"i{p[0]}", offset=1).astype(np.int64) for p in (first, second))
    a, new = np.cumsum(steps), steps != 0
    if len(new):
        new[0] = True
    sums = np.cumsum(after)
    starts = np.flatnonzero(new)
    return a, sums - np.repeat((sums - after)[starts], np.diff(np.append(starts, len(a))))


def _pairs(plain: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that words stand for."""
    found, rest = [], bits.view(np.uint64).copy()
    at = np.arange(len(rest))
    while len(at):
        low = rest & (~rest + np.uint64(1))
        found.append((at, np.bitwise_count(low - np.uint64(1)).astype(np.int64)))
        rest = rest ^ low
        more = rest != 0
        at, rest = at[more], rest[more]
    if not found:
        return plain[:0], plain[:0]
    at = np.concatenate([f[0] for f in found])
    return plain[at], (word[at] << 6) | np.concatenate([f[1] for f in found])


def _send(words: DataFrame, side: int, p: int, q: int) -> DataFrame:
    """Words (plain, word, bits) as written pairs for each cell that needs them. Side 0: left, 1: right, 2: mask."""

    def flush(held: list) -> list[pa.RecordBatch]:
        plain, word, bits = (np.concatenate([h[i] for h in held]) for i in range(3))
        keep = bits != 0
        a, b = _pairs(plain[keep], word[keep], bits[keep])
        rows, columns = (_dealt(a, p) if side != 1 else None), (_dealt(b >> 6, q) if side else None)
        block = rows if side == 0 else columns if side == 1 else rows * q + columns
        order = np.argsort(block, kind="stable")
        a, b, block = a[order], b[order], block[order]
        out = []
        for mine in np.split(np.arange(len(a)), np.flatnonzero(np.diff(block)) + 1):
            if len(mine):
                k = int(block[mine[0]])
                data = _written(a[mine], b[mine])
                raw, data = len(data), pa.compress(data, "zstd", asbytes=True)
                cells = [k * q + i for i in range(q)] if side == 0 else [i * q + k for i in range(p)] if side == 1 else [k]
                for c in cells:
                    out.append(pa.record_batch([pa.array([c], pa.int32()), pa.array([side], pa.int32()), pa.array([raw], pa.int64()), pa.array([data], pa.binary())], names=["_cell", "_side", "_size", "_data"]))
        return out

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            n += b.num_rows
            if n >= 500_000:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return words.mapInArrow(run, _SENT)


def _ranked(values: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value, or of ``among``, there; -1 if it has none."""
    among = values if among is None else among
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    if not len(values) or high - low > 8 * len(values) + 1000:
        found = np.unique(values)
        at = np.minimum(np.searchsorted(found, among), max(len(found) - 1, 0))
        return found, np.where(found[at] == among, at, -1) if len(found) else np.full(len(among), -1)
    there = np.zeros(high - low + 1, bool)
    there[values - low] = True
    places = np.where(there, np.cumsum(there) - 1, -1)
    inside = (among >= low) & (among <= high)
    return np.flatnonzero(there) + low, np.where(inside, places[np.where(inside, among, low) - low], -1)


def _multiply(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, mask: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[np.ndarray, ...]]:
    """Words (x, word, bits) of all (x, z) with (x, y) in a, b and (y, z) in c, d."""
    ys, row = _ranked(c)
    at = _ranked(c, b)[1]
    a, at = a[at >= 0], at[at >= 0]
    order = np.argsort(a, kind="stable")
    a, at = a[order], at[order]
    if not len(a):
        return []
    starts = np.flatnonzero(np.append(True, np.diff(a) != 0))
    xs, ends = a[starts], np.append(starts[1:], len(a))
    words, column = _ranked(d >> 6)
    bit = np.left_shift(np.uint64(1), (d & 63).astype(np.uint64))
    wide, out = max(1, DENSE_MB * 1_000_000 // 8 // len(ys)), []
    for low in range(0, len(words), wide):
        n = min(wide, len(words) - low)
        mine = (column >= low) & (column < low + n)
        dense = np.zeros(len(ys) * n, np.uint64)
        np.bitwise_or.at(dense, row[mine] * n + (column[mine] - low), bit[mine])
        dense = dense.reshape(len(ys), n)
        found = np.zeros((len(xs), n), np.uint64)
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            for k in range(s, e, AT_ONCE):
                found[i] |= np.bitwise_or.reduce(dense[at[k : min(e, k + AT_ONCE)]], axis=0)
        if mask is not None:
            mx, mz = mask
            i, j = _ranked(xs, mx)[1], _ranked(words, mz >> 6)[1] - low
            same = (i >= 0) & (j >= 0) & (j < n)
            only = np.zeros(len(xs) * n, np.uint64)
            np.bitwise_or.at(only, i[same] * n + j[same], np.left_shift(np.uint64(1), (mz[same] & 63).astype(np.uint64)))
            found &= only.reshape(len(xs), n)
        i, j = np.nonzero(found)
        out.append((xs[i], words[low + j], found[i, j].view(np.int64)))
    return out


def product(left: DataFrame, right: DataFrame, sizes: tuple[int, int], mask: DataFrame | None = None) -> DataFrame:
    """Words (x, word of z, bits) with one row each, of ``left`` (x, word of y, bits) and ``right`` (y, word of z, bits), which hold so many
    pairs; only of the pairs of ``mask`` (x, word of z, bits), if one is given."""
    names = [left.columns[0], *right.columns[1:]]
    p, q = (max(1, math.ceil(n / CELL)) for n in sizes)
    sent = _send(left, 0, p, q).union(_send(right, 1, p, q))
    if mask is not None:
        sent = sent.union(_send(mask, 2, p, q))
    masked, kind = mask is not None, pa.schema([(n, pa.int64()) for n in names])

    def cell(table: pa.Table) -> pa.Table:
        held = {0: [], 1: [], 2: []}
        for side, size, data in zip(*(table.column(c) for c in ("_side", "_size", "_data")), strict=True):
            held[side.as_py()].append(_read(pa.decompress(data.as_buffer(), decompressed_size=size.as_py(), codec="zstd", asbytes=True)))
        sides = [tuple(np.concatenate([h[i] for h in held[k]]) if held[k] else np.zeros(0, np.int64) for i in range(2)) for k in range(3)]
        made = _multiply(*sides[0], *sides[1], sides[2] if masked else None)
        return pa.concat_tables([pa.table([pa.array(c) for c in m], schema=kind) for m in made]) if made else kind.empty_table()

    return sent.repartition(p * q, "_cell").groupBy("_cell").applyInArrow(cell, ", ".join(f"`{n}` long" for n in names))
