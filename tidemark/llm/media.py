"""Media columns: ISO base media files in a binary column.

``encode`` stores any bytes losslessly as an audio track of 8-bit samples; ``index`` walks the nested boxes of any
ISO media file, decodes the sample tables and fragment runs of all tracks and keeps codec, duration and the byte ranges of
keyframes: of each track in ``tracks``, of the first one in columns of their own. The payload is never decoded: it is addressed
through the tables alone. One row is one file, so nothing is shuffled and memory is bounded by one Arrow batch of rows.

Files come from anywhere: every count is checked against the bytes that are there before anything is allocated, a file of n bytes
gives at most n samples a track, and whatever is cut off or contradicts itself gives a null index and a reason in ``error``.

Nulls: a null payload is stored as the empty one; a null media file has an ``error``. Texts of any length are stored whole.
Rows with equal bytes give equal results, whatever their ids; repeated rows give repeated results and an empty table an empty
one. Columns other than key and payload are not read, so they cannot clash."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import by_batch, raw_texts

UNIT = 64  # bytes of payload in one media sample: 64 mono samples of 8 bits
RATE = 8000  # 8-bit samples a second
PER_CHUNK = 256  # media samples in a chunk
SYNC_EVERY = 16  # every so many media samples one is marked as a sync sample
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf", b"mfra"}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 up to a positive multiple of ``unit``."""
    return payload + bytes(-len(payload) % unit or (0 if payload else unit))


def encode_media(payload: bytes) -> bytes:
    """An ISO media file whose only track holds ``payload``, padded, as uncompressed 8-bit mono audio."""
    data = pad(payload)
    n = len(data) // UNIT
    chunks, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)
    starts = np.arange(chunks + bool(rest), dtype=np.int64) * (PER_CHUNK * UNIT)
    syncs = np.arange(1, n + 1, SYNC_EVERY, dtype=">u4")
    entry = box(b"raw ", struct.pack(">6xH8xHH4xI", 1, 1, 8, RATE << 16))
    wide = len(data) >= 1 << 31

    def movie(base: int) -> bytes:
        at = (starts + base).astype(">u8" if wide else ">u4").tobytes()
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(syncs)), syncs.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), at),
        )
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
        head = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(data), 0x55C4, 0), version=1)
        media = box(b"mdia", head, full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, len(data), 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3), media)
        times = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, len(data), 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", times, track, box(b"udta", box(b"blen", struct.pack(">Q", len(payload)))))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
    head = 16 if len(data) + 8 >= 1 << 32 else 8
    return b"".join((kind, movie(len(kind) + len(movie(0)) + head), box(b"mdat", data)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Every box, nested ones after their parent: (path, first content byte, end). Sizes 0 (to the end) and 1 (64 bits) count."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        at, end, path = todo.pop()
        if at + 8 > end:
            if at != end:
                raise ValueError("a box header is cut off")
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} does not fit its parent")
        todo.append((at + size, end, path))
        yield (*path, kind), at + head, at + size
        if kind in NESTED:
            todo.append((at + head, at + size, (*path, kind)))


@dataclass
class Track:
    number: int = 0  # its track id
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    spans: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # start and size of each sample
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # decode time of each sample
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # from decode to composition time of each sample
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # positions of sync samples, from 0


@dataclass
class Media:
    brand: str = ""
    tracks: list[Track] = field(default_factory=list)
    extra: dict[bytes, bytes] = field(default_factory=dict)  # boxes of moov/udta


def _words(data: bytes, at: int, end: int, n: int, kind: str) -> np.ndarray:
    if n * np.dtype(kind).itemsize > end - at:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _runs(data: bytes, at: int, end: int, n: int, kind: str) -> np.ndarray:
    """``n`` values, at most, from a table of (how many, value)."""
    steps = _words(data, at + 8, end, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 2)
    upto = np.minimum(np.cumsum(steps[:, 0]), n)
    return np.repeat(steps[:, 1].astype(">u4").astype(kind).astype(np.int64), np.diff(upto, prepend=0))


def _samples(t: dict[bytes, tuple[int, int]], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans, decode times, composition shifts and sync positions from one track's sample tables."""
    get = lambda kind: t.get(kind, (0, 0))
    if b"stsz" in t:
        at, end = get(b"stsz")
        same, n = struct.unpack_from(">II", data, at + 4)
        if same and n > len(data):
            raise ValueError("a sample table has more samples than the file has bytes")
        sizes = np.full(n, same, np.int64) if same else _words(data, at + 12, end, n, ">u4")
    else:
        at, end = get(b"stz2")
        bits, n = struct.unpack_from(">II", data, at + 4)
        bits &= 255
        if bits not in (4, 8, 16):
            raise ValueError("sizes of a sample table have no known width")
        sizes = _words(data, at + 12, end, (n + 1) // 2 if bits == 4 else n, ">u2" if bits == 16 else "u1")
        sizes = np.stack([sizes >> 4, sizes & 15], axis=1).ravel()[:n] if bits == 4 else sizes
    at, end = get(b"co64") if b"co64" in t else get(b"stco")
    starts = _words(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u8" if b"co64" in t else ">u4")
    at, end = get(b"stsc")
    runs = _words(data, at + 8, end, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 3)
    lengths = np.diff(np.append(runs[:, 0], len(starts) + 1))
    if len(runs) and (runs[0, 0] != 1 or lengths.min() < 0):
        raise ValueError("the chunk table is out of order")
    per = np.repeat(runs[:, 1], lengths)
    if len(per) != len(starts) or per.sum() != n or (len(per) and per.max() > n):
        raise ValueError("the chunk table does not add up to the samples")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    inside = before - np.repeat(before[first[per > 0]], per[per > 0]) if n else before
    spans = np.stack([np.repeat(starts, per) + inside, sizes], axis=1)
    if n and (spans.min() < 0 or spans.max() > len(data) or (spans[:, 0] + spans[:, 1]).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    times, shifts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if b"stts" in t:
        deltas = _runs(data, *get(b"stts"), n, ">u4")
        times[: len(deltas)] = np.cumsum(deltas) - deltas
    if b"ctts" in t:
        moved = _runs(data, *get(b"ctts"), n, ">i4" if data[get(b"ctts")[0]] else ">u4")
        shifts[: len(moved)] = moved
    keys = np.arange(n)  # without a sync table every sample is a sync sample
    if b"stss" in t:
        at, end = get(b"stss")
        keys = _words(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4") - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("a sync sample does not exist")
    return spans, times, shifts, keys


class _Fragments:
    """Samples of movie fragments, added to the tracks of ``media`` in the order of the file."""

    def __init__(self, data: bytes, media: Media) -> None:
        self.data, self.media = data, media
        self.defaults: dict[int, tuple[int, int, int]] = {}  # by track id: duration, size and flags of a sample
        self.ends: dict[int, int] = {}  # by track id: the decode time at which it ends
        self.moof = self.next = 0
        self.track: Track | None = None

    def box(self, kind: bytes, at: int, end: int) -> None:
        def take(form: str, skip: int = 4) -> tuple:
            if at + skip + struct.calcsize(form) > end:
                raise ValueError("a box is cut off")
            return struct.unpack_from(form, self.data, at + skip)

        if kind == b"trex":
            number, _, *values = take(">5I")
            self.defaults[number] = tuple(values)
        elif kind == b"moof":
            self.moof = self.next = at - (8 if self.data[at - 4 : at] == kind else 16)
        elif kind == b"traf":
            self.track = None
        elif kind == b"tfhd":
            flags, number = take(">II", 0)
            if (track := next((t for t in self.media.tracks if t.number == number), None)) is None:
                raise ValueError("a fragment names a track that does not exist")
            self.track, skip, values = track, 8, list(self.defaults.get(number, (0, 0, 0)))
            if flags & 1:
                self.next, skip = take(">Q", skip)[0], skip + 8
            elif flags & 0x20000:
                self.next = self.moof
            self.base = self.next
            skip += 4 * bool(flags & 2)
            for i, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    values[i], skip = take(">I", skip)[0], skip + 4
            self.values = values
            if number not in self.ends:
                self.ends[number] = track.duration if len(track.spans) else 0
        elif self.track is None:
            raise ValueError("a fragment has no header")
        elif kind == b"tfdt":
            self.ends[self.track.number] = take(">Q" if self.data[at] else ">I")[0]
        elif kind == b"trun":
            self.run(at, end, *take(">II", 0))

    def run(self, at: int, end: int, flags: int, n: int) -> None:
        track, skip, start, first = self.track, at + 8, self.next, None
        if flags & 1:
            start, skip = self.base + struct.unpack_from(">i", self.data, skip)[0], skip + 4
        if flags & 4:
            first, skip = struct.unpack_from(">I", self.data, skip)[0], skip + 4
        bits = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
        if not bits and n > len(self.data):
            raise ValueError("a fragment run has more samples than the file has bytes")
        table = _words(self.data, skip, end, n * len(bits), ">u4").reshape(n, len(bits)) if bits else None
        column = lambda bit, same: table[:, bits.index(bit)] if bit in bits else np.full(n, same, np.int64)
        steps, sizes, marks = (column(b, v) for b, v in zip((0x100, 0x200, 0x400), self.values, strict=True))
        if n and first is not None:
            marks = np.append(first, marks[1:])
        self.next = start + int(sizes.sum())
        if start < 0 or self.next > len(self.data) or n and sizes.max() > len(self.data):
            raise ValueError("a sample lies outside the file")
        if len(track.spans) + n > len(self.data):
            raise ValueError("a track has more samples than the file has bytes")
        begin = self.ends[track.number]
        self.ends[track.number] = begin + int(steps.sum())
        track.keys = np.append(track.keys, len(track.spans) + np.flatnonzero(~marks & 0x10000))
        track.spans = np.concatenate([track.spans, np.stack([start + np.cumsum(sizes) - sizes, sizes], axis=1)])
        track.times = np.append(track.times, begin + np.cumsum(steps) - steps)
        shifts = column(0x800, 0)  # version 0 has unsigned shifts
        track.shifts = np.append(track.shifts, np.where(shifts >= 1 << 31, shifts - (1 << 32), shifts) if self.data[at] else shifts)
        track.duration = max(track.duration, self.ends[track.number])


def parse_media(data: bytes) -> Media:
    """Tracks with their sample tables, from the boxes alone. ValueError if ``data`` is no ISO media file."""
    media, tables, runs = Media(), [], []
    fragments = _Fragments(data, media)
    try:
        boxes = list(walk(data))
        if not boxes or boxes[0][0][-1] not in (b"ftyp", b"moov", b"styp", b"mdat", b"wide", b"free"):
            raise ValueError("no ISO media file")
        for path, at, end in boxes:
            kind = path[-1]
            if path == (b"ftyp",):
                media.brand = data[at : at + 4].decode("latin-1")
            elif path == (b"moov", b"trak"):
                media.tracks.append(Track())
                tables.append({})
            elif path[:2] == (b"moov", b"udta") and len(path) == 3:
                media.extra[kind] = data[at:end]
            elif end > len(data) or kind in (b"tkhd", b"mdhd") and end - at < 20:
                raise ValueError("a box is cut off")
            elif path == (b"moov", b"trak", b"tkhd"):
                media.tracks[-1].number = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            elif path[0] == b"moof" and kind in (b"moof", b"traf", b"tfhd", b"tfdt", b"trun") or path == (b"moov", b"mvex", b"trex"):
                runs.append((kind, at, end))  # after all sample tables
            elif path[:2] == (b"moov", b"trak") and len(path) > 3:
                track = media.tracks[-1]
                if kind == b"hdlr":
                    track.handler = data[at + 8 : at + 12].decode("latin-1")
                elif kind == b"mdhd":
                    track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
                elif kind == b"stsd":
                    track.codec = data[at + 12 : at + 16].decode("latin-1")
                elif path[-2] == b"stbl":
                    tables[-1][kind] = at, end
        for track, found in zip(media.tracks, tables, strict=True):
            if b"stsc" in found and found.keys() & {b"stsz", b"stz2"} and found.keys() & {b"stco", b"co64"}:
                track.spans, track.times, track.shifts, track.keys = _samples(found, data)
        for kind, at, end in runs:
            fragments.box(kind, at, end)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError("a box is cut off") from e
    return media


def read_back(data: bytes, media: Media, track: int = 0) -> bytes:
    """The stored payload, joined from the byte ranges that the sample tables give."""
    spans = media.tracks[track].spans
    if not len(spans):
        return b""
    ends = spans.sum(axis=1)
    cuts = np.flatnonzero(ends[:-1] != spans[1:, 0]) + 1  # neighbours in the file are read at once
    first, last = np.append(0, cuts), np.append(cuts, len(spans)) - 1
    return b"".join(data[a:b] for a, b in zip(spans[first, 0].tolist(), ends[last].tolist(), strict=True))


def encode(df: DataFrame, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """(key, media): each row's text or bytes as an ISO media file."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [encode_media(x) for x in raw_texts(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(media, pa.binary())], names=[key, "media"])

    kind = df.schema[key].dataType.simpleString()
    return by_batch(df.select(key, payload), run, f"`{key}` {kind}, media binary")


INDEX = (
    "media_bytes long, media_sha256 string, brand string, handler string, codec string, duration_s double, n_samples long, "
    "n_keyframes long, keyframe_ranges array<struct<start: long, size: long>>, n_bytes long, payload_bytes long, "
    "payload_sha256 string, tail_crc32 long, error string, tracks array<struct<handler: string, codec: string, duration_s: double, "
    "n_samples: long, n_keyframes: long, keyframe_ranges: array<struct<start: long, size: long>>>>"
)


def _entry(track: Track) -> dict:
    ranges = [{"start": a, "size": b} for a, b in track.spans[track.keys].tolist()]
    return {
        "handler": track.handler, "codec": track.codec, "duration_s": track.duration / track.timescale if track.timescale else None,
        "n_samples": len(track.spans), "n_keyframes": len(track.keys), "keyframe_ranges": ranges,
    }


def index_media(data: bytes | None) -> dict:
    """One file's row of ``index``."""
    data = data or b""
    row = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        media = parse_media(data)
        if not media.tracks:
            raise ValueError("no track")
        payload = read_back(data, media)
    except ValueError as e:
        return row | {"error": str(e)}
    tracks = [_entry(t) for t in media.tracks]
    length = media.extra.get(b"blen", b"")
    return row | {
        "brand": media.brand, **tracks[0], "tracks": tracks,
        "n_bytes": struct.unpack(">Q", length)[0] if len(length) == 8 else None, "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
    }


def index(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, codec, duration, keyframe byte ranges, digests of the payload as read back, ...) of a column of media files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {INDEX}"
    arrow = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist([index_media(x) for x in batch.column(1).to_pylist()], arrow)
        return pa.record_batch([batch.column(0), *rows.columns], names=[key, *arrow.names])

    return by_batch(df.select(key, media), run, schema)
