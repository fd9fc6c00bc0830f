"""TIFF columns: a reader that walks image directories and yields one row per page, and a small writer.

The reader takes both byte orders, chained directories, strips and tiles, no compression (1), LZW (5), deflate
(8 and 32946) and PackBits (32773), predictor 2, and 8-bit samples in chunky or planar order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read_table

#: Fixed values of the TIFF 6.0 format: bytes of each field type, tags and compression schemes.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The bytes aren't a TIFF file that this reader takes."""


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    compression: int
    pixels: np.ndarray  # (height, width, samples) of uint8


def packbits_decode(data: bytes) -> bytes:
    out, at, end = [], 0, len(data)
    while at < end:
        n = data[at]
        at += 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes are repeated, the rest is copied, 128 bytes at most each."""
    raw, out = np.frombuffer(data, np.uint8), []
    edges = np.flatnonzero(np.diff(raw)) + 1 if len(raw) else np.zeros(0, np.int64)
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(raw)]])
    long = ends - starts >= 3
    plain = 0

    def copied(upto: int) -> None:
        for k in range(plain, upto, 128):
            part = data[k : min(k + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        copied(s)
        for k in range(s, e, 128):
            n = min(128, e - k)
            out.append(bytes([257 - n if n > 1 else 0, data[k]]))
        plain = e
    copied(len(data))
    return b"".join(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, that widen one code early; 256 clears the table and 257 ends."""
    table: list[bytes] = []
    out: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not table:
            raise TiffError("LZW data doesn't begin with a clear code")
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code beyond the table")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    held = bits = 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    at, n = 0, 258
    word = b""
    for at in range(len(data)):
        longer = word + data[at : at + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = n
        n += 1
        word = data[at : at + 1]
        if n == 4094:
            put(table[word])
            word = b""
            clear()
            n = 258
        else:
            width = 9 if n < 511 + 1 else 10 if n < 1023 + 1 else 11 if n < 2047 + 1 else 12
    if word:
        put(table[word])
        width = 9 if n + 1 < 512 else 10 if n + 1 < 1024 else 11 if n + 1 < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    raise TiffError(f"compression {compression}")


def read_pages(data: bytes) -> Iterator[Page]:
    """Walk the directories from the first one on; a loop of directories is an error."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen, page = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("broken chain of directories")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_BYTES.get(kind, 1) * count
            place = at + 2 + 12 * k + 8
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, place)
        yield one_page(data, tags, page)
        at, page = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0], page + 1


def one_page(data: bytes, tags: dict[int, tuple[int, ...]], page: int) -> Page:
    get = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = get(WIDTH, 0), get(HEIGHT, 0), get(SAMPLES, 1)
    compression, predictor = get(COMPRESSION, NONE), get(PREDICTOR, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))) or predictor not in (1, 2):
        raise TiffError("only 8-bit samples and predictors 1 and 2 are taken")
    tiled = TILE_OFFSETS in tags
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    part_w, part_h = (get(TILE_WIDTH, 0), get(TILE_HEIGHT, 0)) if tiled else (width, min(get(ROWS_PER_STRIP, height), height))
    across, down = -(-width // part_w), -(-height // part_h)
    planes = samples if get(PLANAR, 1) == 2 else 1
    depth = samples // planes
    pixels = np.zeros((height, width, samples), np.uint8)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * part_h, place % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        raw = np.frombuffer(unpacked(data[offset : offset + count], compression), np.uint8)
        part = raw[: rows * part_w * depth].reshape(rows, part_w, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        h, w = min(rows, height - y), min(part_w, width - x)
        pixels[y : y + h, x : x + w, plane * depth : (plane + 1) * depth] = part[:h, :w]
    return Page(page, width, height, samples, compression, pixels)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 1024) -> bytes:
    """Little-endian TIFF of (height, width[, samples]) uint8 arrays; ``tile`` is (width, height), multiples of 16."""
    packed = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode, LZW: lzw_encode}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in pages:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        part_w, part_h = tile or (width, min(rows_per_strip, height))
        offsets, counts = [], []
        for y in range(0, height, part_h):
            for x in range(0, width, part_w):
                part = image[y : y + part_h, x : x + part_w]
                if tile:
                    part = np.pad(part, ((0, part_h - part.shape[0]), (0, part_w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1, samples), np.uint8))
                body = packed(part.tobytes())
                offsets.append(len(out))
                counts.append(len(body))
                out += body
        tags = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8] * samples), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if samples == 3 else 1]), (SAMPLES, [samples]), (PREDICTOR, [predictor])]
        tags += [(TILE_WIDTH, [part_w]), (TILE_HEIGHT, [part_h]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [part_h]), (STRIP_COUNTS, counts)]
        fields = []
        for tag, values in sorted(tags):
            kind, code = (3, "H") if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR) else (4, "I")
            body = struct.pack(f"<{len(values)}{code}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += body
            else:
                place = body.ljust(4, b"\0")
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of each TIFF value: key, page, width, height, samples, compression, pixels, error.

    A null value gives no row; a value that can't be read gives one row with page null and the error.
    """

    def pages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            if not data.is_valid:
                continue
            rows, fault = [], None
            try:
                rows = [(p.page, p.width, p.height, p.samples, p.compression, p.pixels.tobytes()) for p in read_pages(data.as_py())]
            except (TiffError, struct.error, zlib.error, KeyError, ValueError, IndexError, ZeroDivisionError) as error:
                fault, rows = str(error) or type(error).__name__, [(None,) * 6]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch(
                [pa.array([name.as_py()] * len(rows), batch.schema.field(0).type)]
                + [pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 5 + [pa.binary()], strict=True)]
                + [pa.array([fault] * len(rows), pa.string())],
                names=["key", "page", "width", "height", "samples", "compression", "pixels", "error"],
            ) if rows else None

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, page int, width int, height int, samples int, compression int, pixels binary, error string"
    return map_arrow(df.select(key, media), lambda b: (x for x in pages(b) if x is not None), schema)


#: Bytes of a row of the stored image, so that any padded payload is a whole image.
ROW = 64


#: Rows of a page; a longer payload has several, one directory after the other.
PAGE_ROWS = 512


def stored(payload: bytes) -> bytes:
    """A payload of whole rows as a TIFF. The layout depends on the payload alone, so that strips and tiles, deflate,
    LZW and PackBits, with and without predictor, and files of several pages all occur in a corpus. LZW has one
    payload in eight, as it is coded byte by byte."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    pages = [image[at : at + PAGE_ROWS] for at in range(0, len(image), PAGE_ROWS)]
    layout = zlib.crc32(payload) % 8
    if layout == 0:
        return write_pages(pages, LZW, predictor=1 + len(image) % 2)
    if layout < 3:
        return write_pages(pages, DEFLATE, predictor=2)
    if layout < 6:
        return write_pages(pages, DEFLATE, tile=(ROW, 256))
    return write_pages(pages, PACKBITS)


def feature(pixels: np.ndarray) -> str:
    """Height, mean and standard deviation in thousandths, and a 64-bit average hash over an 8 by 8 grid."""
    image = pixels[:, :, 0]
    edges = np.linspace(0, image.shape[0], 9).astype(np.int64)[:8]
    sums = np.add.reduceat(image.reshape(image.shape[0], 8, -1).sum(axis=2, dtype=np.int64), np.minimum(edges, image.shape[0] - 1), axis=0)
    sizes = np.maximum(1, np.diff(np.append(edges, image.shape[0])))[:, None] * (image.shape[1] // 8)
    # integer compare of cell mean against the whole mean
    bits = (sums * image.size > sizes * image.sum(dtype=np.int64)).reshape(-1)
    total, squares = int(image.sum(dtype=np.int64)), int(np.square(image.astype(np.int64)).sum())
    deviation = (squares * image.size - total * total) * 1_000_000 // (image.size * image.size)
    return f"h{image.shape[0]}:m{total * 1000 // image.size}:v{deviation}:a{int(np.packbits(bits).tobytes().hex(), 16):016x}"


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a TIFF of one page or more and read it back.

    The payload is the text's UTF-8 bytes (null: empty) and bytes 0 up to a positive multiple of 64. The digests and
    the feature are made from the decoded pixels, and media_* describe the stored file. Nothing else of the row is
    used, so equal texts give equal values; repeated rows give repeated rows.
    """

    def digests(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for value in batch.column(1):
            body = value.as_py().encode() if value.is_valid else b""
            media = stored(body + b"\0" * (-len(body) % ROW or (ROW if not body else 0)))
            pixels = np.concatenate([page.pixels for page in read_pages(media)])
            payload = pixels.tobytes()
            rows.append((len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read_table(spark, sf_dir, "documents"))
