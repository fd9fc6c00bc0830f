import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyrail.llm import tiff

CODECS = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(codec, tile):
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 70, 3), (100, 64), (900, 64)):
        for predictor in (1, 2):
            pages = [rng.integers(0, high, shape).astype(np.uint8) for high in (3, 256)]
            got = list(tiff.read_pages(tiff.write_pages(pages, codec, predictor, tile, rows_per_strip=40)))
            assert [p.page for p in got] == [0, 1]
            assert all(np.array_equal(g.pixels.reshape(w.shape), w) for g, w in zip(got, pages, strict=True))


def test_big_endian_file():
    body = bytes(range(6))
    fields = [(256, 3), (257, 2), (258, 8), (259, 1), (262, 1), (273, 8), (277, 1), (278, 2), (279, 6)]
    data = b"MM\0*" + struct.pack(">I", 14) + body + struct.pack(">H", len(fields))
    data += b"".join(struct.pack(">HHII", tag, 4, 1, value) for tag, value in fields) + b"\0\0\0\0"
    assert next(tiff.read_pages(data)).pixels.tobytes() == body


def test_known_packbits():
    packed = bytes.fromhex("FEAA02800 02A FDAA0380002A22F7AA".replace(" ", ""))
    want = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed) == want and tiff.packbits_decode(tiff.packbits_encode(want)) == want


def test_pages_of_bad_files(spark):
    loop = bytearray(tiff.write_pages([np.zeros((2, 2), np.uint8)]))
    loop[-4:] = loop[4:8]
    rows = [(1, tiff.write_pages([np.zeros((2, 2), np.uint8)] * 3)), (2, None), (3, b"no"), (4, bytes(loop)), (5, b"")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()
    assert sorted((r.key, r.page) for r in got if r.error is None) == [(1, 0), (1, 1), (1, 2)]
    assert sorted(r.key for r in got if r.error is not None) == [3, 4, 5]


def test_text_media(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "z" * 200_000, "the same", "the same"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in tiff.text_media(docs).collect()}
    for k, text in enumerate(texts):
        body = (text or "").encode()
        padded = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert got[k].media_bytes > 0 and got[k].feature
    assert got[7][1:] == got[8][1:] and got[0][1:] == got[1][1:]
    assert tiff.text_media(docs.limit(0)).count() == 0


def test_stored_layouts():
    """Every layout occurs, and a long payload has several pages that follow each other."""
    seen = set()
    for k in range(200):
        payload = (b"%d some words " % k * (3000 if k % 50 == 0 else k + 1))
        payload += b"\0" * (-len(payload) % tiff.ROW)
        pages = list(tiff.read_pages(tiff.stored(payload)))
        assert b"".join(p.pixels.tobytes() for p in pages) == payload
        assert len(pages) == -(-len(payload) // (tiff.ROW * tiff.PAGE_ROWS))
        seen.add((pages[0].compression, len(pages) > 1))
    assert {c for c, _ in seen} == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS} and {many for _, many in seen} == {True, False}
