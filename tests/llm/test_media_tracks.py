"""Files with several tracks, compact sample sizes and movie fragments."""

import random
import re
import struct

import pytest

from tidemark.llm.media import box, encode_media, full, index_media, parse_media

I = lambda *n: struct.pack(f">{len(n)}I", *n)  # noqa: E731, E741


def track(number, handler, codec, *tables):
    media = box(b"mdia", full(b"mdhd", I(0, 0, 10, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, handler)), box(b"minf", box(b"stbl", full(b"stsd", I(1), box(codec)), *tables)))
    return box(b"trak", full(b"tkhd", I(0, 0, number, 0)), media)


def tables(sizes, start, syncs):
    return sizes, full(b"stsc", I(1, 1, 3, 1)), full(b"stco", I(1, start)), full(b"stss", I(len(syncs), *syncs))


def test_every_track_has_its_entry():
    data = box(b"mdat", bytes(40))
    sound = track(1, b"soun", b"mp4a", *tables(full(b"stsz", I(2, 3)), 8, [1, 2, 3]))
    picture = track(2, b"vide", b"avc1", *tables(full(b"stsz", I(0, 3, 5, 6, 7)), 20, [1, 3]))
    row = index_media(data + box(b"moov", sound, picture))
    assert row["handler"] == "soun" and [(t["handler"], t["codec"], t["n_samples"]) for t in row["tracks"]] == [("soun", "mp4a", 3), ("vide", "avc1", 3)]
    assert row["tracks"][1]["keyframe_ranges"] == [{"start": 20, "size": 5}, {"start": 31, "size": 7}]


@pytest.mark.parametrize("bits, body", [(4, b"\x56\x70"), (8, b"\x05\x06\x07"), (16, b"\0\x05\0\x06\0\x07")])
def test_compact_sizes(bits, body):
    row = index_media(box(b"mdat", bytes(40)) + box(b"moov", track(1, b"vide", b"avc1", *tables(full(b"stz2", I(bits, 3), body), 20, [2]))))
    assert row["n_samples"] == 3 and row["keyframe_ranges"] == [{"start": 25, "size": 6}]


def fragmented(number=2):
    tail = lambda at: box(b"moof", full(b"mfhd", I(1)), *(
        box(b"traf", full(b"tfhd", I(number), flags=0x20000), full(b"tfdt", I(100)), full(b"trun", struct.pack(">IiI", 3, at, 0), I(5, 6, 7), flags=0x205), full(b"trun", I(2, 4, 0, 1, 0x10000), flags=0x600)),
        box(b"traf", full(b"tfhd", I(1, 4, 9), flags=0x20018), full(b"trun", struct.pack(">Ii", 2, at + 23), flags=1)),
    ))
    head = box(b"ftyp", b"isom", I(0)) + box(b"moov", track(1, b"soun", b"mp4a"), track(2, b"vide", b"avc1"), box(b"mvex", full(b"trex", I(1, 1, 0, 0, 0)), full(b"trex", I(2, 1, 3, 0, 0x10000))))
    moof = tail(len(tail(0)) + 8)
    return head + moof + box(b"mdat", bytes(60)), len(head) + len(moof) + 8


def test_fragments():
    data, at = fragmented()
    sound, picture = index_media(data)["tracks"]
    assert (picture["n_samples"], picture["duration_s"]) == (5, 11.5) and picture["keyframe_ranges"] == [{"start": at, "size": 5}, {"start": at + 18, "size": 4}]
    assert parse_media(data).tracks[1].times.tolist() == [100, 103, 106, 109, 112]
    assert (sound["n_samples"], sound["duration_s"]) == (2, 0.8) and sound["keyframe_ranges"] == [{"start": at + 23, "size": 9}, {"start": at + 32, "size": 9}]


def test_bad_fragments_give_a_reason():
    assert "track" in index_media(fragmented(7)[0])["error"] and "outside" in index_media(fragmented()[0][:-60].replace(I(68) + b"mdat", I(8) + b"mdat"))["error"]


def test_composition_times():
    data = box(b"mdat", bytes(40))
    times = full(b"stts", I(1, 3, 10))
    shown = full(b"ctts", I(2, 1, 5, 2, 2**32 - 4), version=1)
    media = parse_media(data + box(b"moov", track(1, b"vide", b"avc1", *tables(full(b"stsz", I(2, 3)), 8, [1]), times, shown)))
    assert media.tracks[0].times.tolist() == [0, 10, 20] and media.tracks[0].shifts.tolist() == [5, -4, -4]


def small_fragmented():
    picture = box(b"trak", full(b"tkhd", I(0, 0, 7, 0)), box(b"mdia", full(b"mdhd", I(0, 0, 10, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"))))
    movie = box(b"moov", picture, box(b"mvex", full(b"trex", I(7, 1, 5, 3, 0))))
    part = box(b"moof", box(b"traf", full(b"tfhd", I(7), flags=0x20000), full(b"tfdt", I(100)), full(b"trun", struct.pack(">IiI", 2, 0, 0x10000) + I(1, 2), flags=0x201 | 4)))
    return box(b"ftyp", b"isom") + movie + part + box(b"mdat", bytes(30))


@pytest.mark.parametrize("make", [lambda: encode_media(b"some text to keep" * 40), small_fragmented])
def test_foreign_bytes_give_an_error_and_nothing_else(make):
    """Files cut short, with flipped bytes and with counts that no memory could hold."""
    good, rng = make(), random.Random(2)
    assert index_media(good).get("error") is None
    for cut in range(0, len(good), max(1, len(good) // 300)):
        index_media(good[:cut])
    at = [m.start() for m in re.finditer(rb"stsz|stsc|stco|stts|stss|trun|tfhd|mdhd|tkhd|trex|stsd", good)]
    for _ in range(4000):
        bad = bytearray(good)
        for _ in range(rng.choice([1, 1, 2, 5])):
            p = rng.choice(at) + rng.randrange(-4, 28) if rng.random() < 0.8 else rng.randrange(len(good))
            bad[min(p, len(good) - 1)] = rng.choice([0, 1, 127, 128, 255, rng.randrange(256)])
        row = index_media(bytes(bad))
        assert row.get("error") is not None or row["n_samples"] <= len(good)


def test_a_claim_of_many_equal_samples_allocates_nothing():
    for same in (0, 1):
        claim = box(b"moov", track(1, b"soun", b"raw ", full(b"stsz", I(same, 2**32 - 1)), full(b"stsc", I(1, 1, 2**32 - 1, 1)), full(b"stco", I(1, 0)), full(b"stts", I(1, 2**32 - 1, 1))))
        assert index_media(claim)["error"]
