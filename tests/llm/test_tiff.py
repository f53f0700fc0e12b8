import os
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import tiff

CASES = [b"\0" * 64, bytes(range(256)) * 3, b"ab" * 6400, os.urandom(64 * 300), b"x" * 64 * 5000]


@pytest.mark.parametrize("how", list(tiff.PACK))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", "<>")
def test_round_trip(how, predictor, order):
    for payload in CASES:
        (got,) = tiff.decode(tiff.to_tiff(payload, how, predictor, order))
        assert got["error"] is None and got["samples"] == payload
        assert (got["width"], got["height"]) == (64, len(payload) // 64)


def test_known_packbits():
    # The example of the TIFF 6.0 text's PackBits section.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_known_lzw():
    # Codes 256 7 258 8 8 258 6 6 257, nine bits each, from the TIFF 6.0 text: 7 7 7 8 8 7 7 6 6.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert tiff.unpack_lzw(data) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))


def tiled(image: np.ndarray, side: int) -> bytes:
    height, width, per = image.shape
    tiles = []
    for y in range(0, height, side):
        for x in range(0, width, side):
            t = np.zeros((side, side, per), np.uint8)
            part = image[y : y + side, x : x + side]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(t.tobytes()))
    counts = [len(t) for t in tiles]
    offsets = [8 + sum(counts[:i]) for i in range(len(counts))]
    at = 8 + sum(counts)
    more = struct.pack(f"<{2 * len(tiles)}I3H", *offsets, *counts, 8, 8, 8)
    fields = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, at + 8 * len(tiles)), (259, 4, 1, 8), (277, 4, 1, per), (322, 4, 1, side), (323, 4, 1, side), (324, 4, len(tiles), at), (325, 4, len(tiles), at + 4 * len(tiles))]
    ifd = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at + len(more)) + b"".join(tiles) + more + ifd


def test_tiles():
    image = np.random.default_rng(1).integers(0, 255, (37, 50, 3), np.uint8)
    (got,) = tiff.decode(tiled(image, 16))
    assert got["error"] is None and got["samples"] == image.tobytes()


def two_pages() -> bytes:
    one = bytearray(tiff.to_tiff(b"a" * 64))
    at = struct.unpack_from("<I", one, 4)[0]
    n = struct.unpack_from("<H", one, at)[0]
    struct.pack_into("<I", one, at + 2 + 12 * n, at)  # a loop: the second visit is an error
    return bytes(one)


def test_pages_and_damage(spark):
    good = tiff.to_tiff(b"z" * 128)
    rows = [(1, good, "x"), (1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"junk", "x"), (5, good[:40], "x"), (6, two_pages(), None)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "media_id long, media binary, page string"), "media_id", "media").collect()
    by = {}
    for r in got:
        by.setdefault(r.media_id, []).append(r)
    assert len(by[1]) == 2 and all(bytes(r.samples) == b"z" * 128 for r in by[1])
    assert 2 not in by and 3 not in by
    assert by[4][0].error and by[5][0].error
    assert [r.page for r in by[6]] == [0, 1] and by[6][1].error


def test_query(spark, tmp_path):
    texts = ["", None, "a" * 63, "é" * 64, "x" * 300_000, "dup", "dup"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in tiff.op6_tiff(spark, str(tmp_path)).collect()}
    import hashlib

    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5].media_sha256 == got[6].media_sha256 and got[5].feature == got[6].feature


def test_query_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, page int, samples string, media_id string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tiff.op6_tiff(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(None, "a", 7, "s", "m"), (None, "a", 7, "s", "m"), (3, None, None, None, None)], schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert sorted((r.doc_id is None, r.n_bytes, r.payload_bytes) for r in tiff.op6_tiff(spark, f"{tmp_path}/odd").collect()) == [(False, 0, 64), (True, 1, 64), (True, 1, 64)]


def test_long_texts_are_several_pages(spark):
    """The features of all pages are those of the text in one."""
    texts = ["", None, "é" * 64, "ab" * 3000, "x" * 64, "y" * 65, "ab" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for how in (1, 2, 5, 1000):
        pages = tiff.tiff_pages(tiff.text_media(docs, page_rows=how), keep=("n_bytes",))
        counts = {r.media_id: r["count"] for r in pages.groupBy("media_id").count().collect()}
        assert counts[3] == -(-94 // how) and counts[0] == counts[1] == 1 and counts[5] == -(-2 // how)
        got = {r.media_id: r for r in tiff.media_features(pages, ("n_bytes",)).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            one = tiff.Features()
            one.add(payload)
            assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].feature) == (len(raw), *one.values())


def test_pages_of_every_kind():
    payload = bytes(range(256)) * 10
    for order in "<>":
        for how in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
            for predictor in (1, 2):
                found = list(tiff.decode(tiff.to_tiff(payload, how, predictor, order, page_rows=7)))
                assert [p["height"] for p in found] == [7, 7, 7, 7, 7, 5] and b"".join(p["samples"] for p in found) == payload


def directory(*fields, data=b""):
    """A file of one directory; fields are (tag, kind, count, value)."""
    import struct

    ifd = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + data


DAMAGED = {
    "tiles without a width": directory((256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (324, 4, 1, 8), (325, 4, 1, 4)),
    "tiles without counts": directory((256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (322, 4, 1, 8), (323, 4, 1, 8), (324, 4, 1, 8)),
    "width in letters": directory((256, 2, 1, 65), (257, 4, 1, 8), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 64)),
    "a huge strip": directory((256, 4, 1, 2**32 - 1), (257, 4, 1, 2**32 - 1), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 64)),
    "a tile of no width": directory((256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8), (322, 4, 1, 0), (323, 4, 1, 8), (324, 4, 1, 8), (325, 4, 1, 8)),
}


def test_damaged_fields():
    for name, data in DAMAGED.items():
        got = list(tiff.decode(data))
        assert len(got) == 1 and got[0]["error"] and got[0]["samples"] is None, name


def test_any_bytes():
    import random

    rng = random.Random(4)
    payload = bytes(rng.randrange(4) for _ in range(64 * 40))
    for how in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        whole = tiff.to_tiff(payload, how, predictor=2)
        for _ in range(400):
            data = bytearray(whole)
            for _ in range(rng.randrange(1, 6)):
                data[rng.randrange(len(data)) if rng.random() < 0.3 else -rng.randrange(1, 160)] = rng.randrange(256)
            for page in tiff.decode(bytes(data[: rng.randrange(len(data) // 2, len(data) + 1)])):
                assert (page["error"] is None) == (page["samples"] is not None)


def test_output_stops_at_the_stated_size():
    assert len(tiff.unpack_bits(bytes((129, 7)) * 100_000, 1000)) < 1200
    assert len(tiff.unpack_lzw(tiff.pack_lzw(b"\0" * 1_000_000), 1000)) < 6000
