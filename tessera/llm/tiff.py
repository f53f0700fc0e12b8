"""TIFF media columns: walk the image directories, decode strips and tiles, one row per page.

The reader takes classic TIFF of either byte order with 8- or 16-bit integer
samples, one or more samples per pixel in chunky order, stored in strips or
tiles, uncompressed or packed by PackBits, LZW or deflate, with no predictor or
horizontal differencing. Directories are walked through their offsets with a
guard against loops; every offset is checked against the file's length.

`tiff_pages` gives one row per page. A null or empty media value gives no row.
A file or page that cannot be decoded, or whose samples take more than MOST bytes,
gives one row with `error` set and null samples, so a damaged file never fails the
job; decoders stop at the size that the page states. Repeated rows repeat, null ids
are kept, an empty table gives no rows, other columns are ignored.

`to_tiff` stores bytes losslessly as 8-bit grey samples, 64 to a row, deflated
in strips, in as many pages as they need, which is how the query stores texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, slices, staged, table

# Fixed values of the TIFF 6.0 format: tags, field types and their sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR = 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

ROW = 64
STRIP_ROWS = 1024
#: Rows of a stored page: 64 MiB of samples. A longer text is several pages.
PAGE_ROWS = 1 << 20
#: Bytes of a page's samples; a larger page is an error, as a small file can state any size.
MOST = 1 << 29
#: Bytes of samples that a batch of pages holds before it is handed on.
BATCH_BYTES = 1 << 26

PAGES = "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, samples binary, error string"


class BadTiff(ValueError):
    """The bytes are not a TIFF that this reader takes."""


def unpack_bits(data: bytes, size: int = MOST) -> bytes:
    """Until size bytes are there."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int = MOST) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early; 256 clears, 257 ends, as do size bytes."""
    out = bytearray()
    words = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise BadTiff("LZW code out of order")
        out += word
        if len(out) >= size:
            break
        if last and len(words) < 4096:
            words.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as runs, the rest as literals."""
    out, i, n, literal = bytearray(), 0, len(data), bytearray()

    def flush() -> None:
        for at in range(0, len(literal), 128):
            part = literal[at : at + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < n:
        j = i
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush()
            out += bytes((257 - (j - i), data[i]))
        else:
            literal += data[i:j]
        i = j
    flush()
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()
    words: dict[bytes, int] = {}
    width, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def code_of(w: bytes) -> int:
        return w[0] if len(w) == 1 else words[w]

    def clear() -> None:
        nonlocal width
        put(256)
        words.clear()
        words.update({bytes((i,)): i for i in range(256)})
        width = 9

    clear()
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in words:
            word += c
            continue
        put(code_of(word))
        words[word + c] = len(words) + 2
        # The table holds its single bytes, the two control codes and what was added.
        if len(words) + 2 >= 4094:
            clear()
        else:
            width = min(12, max(9, (len(words) + 2).bit_length()))
        word = c
    if word:
        put(code_of(word))
        words[word + b"\0\0"] = 0
        width = min(12, max(9, (len(words) + 2).bit_length()))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    """At most size bytes, so that a small file cannot fill memory."""
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise BadTiff(str(e)) from e


PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1)}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """The byte order and the fields of each image directory, in file order."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise BadTiff("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("directory offset out of range or repeated")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise BadTiff("directory cut short")
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in SIZES:
                continue
            code, size = SIZES[kind]
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + size * count > len(data):
                raise BadTiff("field out of range")
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def block(data: bytes, offset: int, count: int, how: int, size: int) -> bytes:
    if offset + count > len(data):
        raise BadTiff("strip or tile out of range")
    raw = data[offset : offset + count]
    if how == NONE:
        got = raw
    elif how == PACKBITS:
        got = unpack_bits(raw, size)
    elif how == LZW:
        got = unpack_lzw(raw, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        got = inflate(raw, size)
    else:
        raise BadTiff(f"compression {how}")
    if len(got) < size:
        raise BadTiff("strip or tile too short")
    return got[:size]


def page(data: bytes, order: str, f: dict[int, tuple[int, ...]]) -> dict:
    """One directory's samples, row by row, pixel by pixel, in the file's byte order."""
    try:
        width, height = f[WIDTH][0], f[HEIGHT][0]
    except KeyError as e:
        raise BadTiff("no width or height") from e
    per, bits = f.get(SAMPLES, (1,))[0], f.get(BITS, (1,))
    how, predictor = f.get(COMPRESSION, (NONE,))[0], f.get(PREDICTOR, (1,))[0]
    if set(bits) not in ({8}, {16}) or f.get(PLANAR, (1,))[0] != 1 and per > 1 or predictor not in (1, 2):
        raise BadTiff("samples of this kind are not taken")
    unit = bits[0] // 8
    kind = np.dtype(f"{order}u{unit}")
    if not all(isinstance(x, int) and x > 0 for x in (width, height, per)):
        raise BadTiff("width, height or samples per pixel are not positive numbers")
    if width * height * per * unit > MOST:
        raise BadTiff("page too large")

    def undone(raw: bytes, rows: int, columns: int) -> np.ndarray:
        x = np.frombuffer(raw, kind).reshape(rows, columns, per)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind) if predictor == 2 else x

    if TILE_OFFSETS in f:
        tw, th = f[TILE_WIDTH][0], f[TILE_HEIGHT][0]
        if tw * th * per * unit > MOST:
            raise BadTiff("tile too large")
        across = -(-width // tw)
        if len(f[TILE_OFFSETS]) < across * -(-height // th):
            raise BadTiff("tiles missing")
        out = np.zeros((height, width, per), kind)
        for i, (offset, count) in enumerate(zip(f[TILE_OFFSETS], f[TILE_COUNTS], strict=True)):
            y, x = i // across * th, i % across * tw
            tile = undone(block(data, offset, count, how, tw * th * per * unit), th, tw)
            out[y : y + th, x : x + tw] = tile[: max(0, height - y), : max(0, width - x)]
        samples = out.tobytes()
    else:
        rows = min(f.get(ROWS_PER_STRIP, (height,))[0], height)
        parts, offsets, counts = [], f.get(STRIP_OFFSETS, ()), f.get(STRIP_COUNTS, ())
        if rows < 1 or len(offsets) < -(-height // rows) or len(offsets) != len(counts):
            raise BadTiff("strips missing")
        for y, offset, count in zip(range(0, height, rows), offsets, counts, strict=False):
            n = min(rows, height - y)
            raw = block(data, offset, count, how, n * width * per * unit)
            parts.append(raw if predictor == 1 else undone(raw, n, width).tobytes())
        samples = b"".join(parts)
    return {"width": width, "height": height, "samples_per_pixel": per, "bits": bits[0], "compression": how, "predictor": predictor, "samples": samples, "error": None}


#: What a field that is missing, of another type or out of range can raise.
DAMAGED = (ArithmeticError, LookupError, TypeError, ValueError, MemoryError)


def decode(data: bytes) -> Iterator[dict]:
    """Each page's columns; what cannot be decoded is a page with an error."""
    bad = dict.fromkeys(("width", "height", "samples_per_pixel", "bits", "compression", "predictor", "samples"))
    walk = directories(data)
    while True:
        try:
            order, fields = next(walk)
        except StopIteration:
            return
        except (struct.error, *DAMAGED) as e:
            yield bad | {"error": str(e)}
            return
        try:
            yield page(data, order, fields)
        except (struct.error, *DAMAGED) as e:
            yield bad | {"error": str(e) or type(e).__name__}


def to_tiff(payload: bytes, how: int = DEFLATE, predictor: int = 1, order: str = "<", page_rows: int = PAGE_ROWS) -> bytes:
    """Pages of 8-bit grey samples, ROW to a row and at most page_rows rows; payload must fill whole rows."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"payload must be a positive multiple of {ROW} bytes")
    data, link = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4)), 4
    for first in range(0, len(payload), ROW * page_rows):
        whole, offsets, counts = payload[first : first + ROW * page_rows], [], []
        for at in range(0, len(whole), ROW * STRIP_ROWS):
            part = whole[at : at + ROW * STRIP_ROWS]
            if predictor == 2:
                x = np.frombuffer(part, np.uint8).reshape(-1, ROW)
                part = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1).tobytes()
            strip = PACK[how](part)
            offsets.append(len(data))
            counts.append(len(strip))
            data += strip
        data += bytes(len(data) % 2)
        n, where = len(counts), len(data)
        if n > 1:
            data += struct.pack(f"{order}{2 * n}I", *offsets, *counts)
        fields = [(WIDTH, 4, 1, ROW), (HEIGHT, 4, 1, len(whole) // ROW), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, how), (PHOTOMETRIC, 3, 1, 1), (STRIP_OFFSETS, 4, n, where if n > 1 else offsets[0]), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_COUNTS, 4, n, where + 4 * n if n > 1 else counts[0]), (PREDICTOR, 3, 1, predictor)]
        struct.pack_into(order + "I", data, link, len(data))
        data += struct.pack(order + "H", len(fields))
        for tag, kind, count, value in fields:
            held = struct.pack(order + "HH", value, 0) if kind == 3 and count == 1 else struct.pack(order + "I", value)
            data += struct.pack(order + "HHI", tag, kind, count) + held
        link = len(data)
        data += bytes(4)
    return bytes(data)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page": pa.int32(), **dict.fromkeys(("width", "height", "samples_per_pixel", "bits", "compression", "predictor"), pa.int32()), "samples": pa.binary(), "error": pa.string()}
    def made(batch: pa.RecordBatch, rows: list[dict], of: list[int]) -> pa.RecordBatch:
        kept = batch.drop_columns(["media"]).take(pa.array(of))
        return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([r[n] for r in rows], kind) for n, kind in kinds.items()]], [*kept.schema.names, *kinds])

    for batch in slices(batches, "media"):
        rows, of, held = [], [], 0
        for i, media in enumerate(batch.column("media").to_pylist()):
            for n, found in enumerate(decode(media) if media else ()):
                rows.append({"page": n} | found)
                of.append(i)
                held += len(found["samples"] or b"")
                if held > BATCH_BYTES:
                    yield made(batch, rows, of)
                    rows, of, held = [], [], 0
        if rows:
            yield made(batch, rows, of)


def tiff_pages(media: DataFrame, id_col: str = "media_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each media value: its id as media_id, the kept columns, then PAGES.

    Narrow, so copies and hot groups do not matter.
    """
    chosen = picked(media, media_id=id_col, **{n: n for n in keep}, media=media_col)
    given = ", ".join(f"`{n}` {kind}" for n, kind in chosen.dtypes if n != "media")
    return chosen.mapInArrow(_pages, f"{given}, {PAGES}")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_rows: int = PAGE_ROWS) -> DataFrame:
    """Texts as media: UTF-8 (null: empty), zeros up to a positive multiple of 64, stored as TIFF of pages of at most page_rows rows."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, media = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(to_tiff(raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), page_rows=page_rows))
            yield pa.RecordBatch.from_arrays([batch.column("media_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["media_id", "n_bytes", "media"])

    return picked(docs, media_id=id_col, text=text_col).mapInArrow(stored, "media_id long, n_bytes long, media binary")


FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}


class Features:
    """Size, digest, the checksum of the last row, and statistics of the samples' values, page by page."""

    def __init__(self) -> None:
        self.size, self.digest, self.tail, self.counts = 0, hashlib.sha256(), b"", np.zeros(256, np.int64)

    def add(self, samples: bytes) -> None:
        self.size += len(samples)
        self.digest.update(samples)
        self.tail = samples[-ROW:]
        self.counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)

    def values(self) -> tuple[int, str, int, str]:
        share = self.counts[self.counts > 0] / self.size
        mean = float(self.counts @ np.arange(256)) / self.size
        text = f"{ROW}x{self.size // ROW};mean={mean:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};distinct={len(share)}"
        return self.size, self.digest.hexdigest(), zlib.crc32(self.tail), text


def media_features(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """media_id, the kept columns and FEATURES of media, whose pages (page, samples) follow each other as tiff_pages gives them."""
    chosen = pages.select("media_id", *keep, "page", "samples")
    given = [n for n in chosen.columns if n not in ("page", "samples")]
    kinds = [f"`{n}` {kind}" for n, kind in chosen.dtypes if n in given]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types, now = [*given, *FEATURES], None, None
        for batch in slices(batches, "samples"):
            types, done = [*[batch.schema.field(n).type for n in given], *FEATURES.values()], []
            for page, samples, *row in zip(*(batch.column(n).to_pylist() for n in ("page", "samples", *given)), strict=True):
                if page == 0:
                    if now:
                        done.append((*now[0], *now[1].values()))
                    now = row, Features()
                now[1].add(samples)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now[0], *now[1].values()), types, strict=True)], names)

    return chosen.mapInArrow(rows, ", ".join(kinds) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts stored as TIFF in the shared folder, read back page by page, with features.

    Everything is narrow: each stored row is decoded where it is read, and its pages
    follow each other in one task. A text of more than PAGE_ROWS rows is several pages,
    each of which is held alone. Null texts are empty, null ids and repeated rows stay,
    no documents give no rows, other columns are ignored.
    """
    media = staged(text_media(table(spark, sf_dir, "documents")), "tiff", "none")
    told = media.select("media_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    kept = ("n_bytes", "media_bytes", "media_sha256")
    pages = tiff_pages(told, keep=kept)
    whole = pages.withColumn("samples", F.coalesce("samples", F.raise_error(F.concat(F.lit("a stored text cannot be read: "), "error")).cast("binary")))
    return media_features(whole, kept).withColumnRenamed("media_id", "doc_id")
