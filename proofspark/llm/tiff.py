"""Media columns: TIFF files as binary values, read page by page.

Reads both byte orders, chained image directories, strips and tiles, chunky and planar, no compression, PackBits, LZW and
deflate, samples of 1, 2, 4, 8, 16 and 32 bits, the horizontal predictor from 8 bits on and the floating-point predictor of 16
and 32 bits. Samples under 8 bits come as a byte each. Writes 8-bit grey pages.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the format: tags, compressions and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 266, 273, 277
ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LZW_CLEAR, LZW_END, LZW_FIRST = 256, 257, 258

#: Pixels a line, lines a page and a strip, side of a tile.
LINE, PAGE_LINES, STRIP_LINES, TILE = 64, 2048, 128, 64
PAGE = "page int, pages int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, problem string"

_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for k in range(0, len(part), 128):
            piece = part[k : k + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in _RUNS.finditer(data):
        literal(data[at : m.start()])
        out += bytes((257 - len(m[0]), m[0][0]))
        at = m.end()
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the table is cleared before a code would need 13."""
    bits, held, out = LZW_CLEAR, 9, bytearray()
    table, width, prefix = {bytes((k,)): k for k in range(256)}, 9, b""
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        bits, held = bits << width | table[prefix], held + width
        table[longer] = len(table) + 2
        width = 12 if len(table) > 2044 else 11 if len(table) > 1020 else 10 if len(table) > 508 else 9
        if len(table) > 4091:
            bits, held = bits << width | LZW_CLEAR, held + width
            table, width = {bytes((k,)): k for k in range(256)}, 9
        prefix = data[k : k + 1]
        if held >= 4096:
            rest = held % 8
            out += (bits >> rest).to_bytes(held // 8, "big")
            bits, held = bits & ((1 << rest) - 1), rest
    if prefix:
        bits, held = bits << width | table[prefix], held + width
        grown = len(table) + 1
        width = 12 if grown > 2044 else 11 if grown > 1020 else 10 if grown > 508 else 9
    bits, held = bits << width | LZW_END, held + width
    fill = -held % 8
    return bytes(out) + (bits << fill).to_bytes((held + fill) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out, table, width, last = bytearray(), [], 9, b""
    first = [bytes((k,)) for k in range(256)] + [b"", b""]
    bits = held = at = 0
    while len(out) < size:
        while held < width and at < len(data):
            more = data[at : at + 64]
            bits, held, at = bits << 8 * len(more) | int.from_bytes(more, "big"), held + 8 * len(more), at + 64
        if held < width:
            break
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if not table:
            table = list(first)
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        size_now = len(table) + 1
        width = 12 if size_now > 2046 else 11 if size_now > 1022 else 10 if size_now > 510 else 9
    return bytes(out)


def _compress(data: bytes, method: int) -> bytes:
    return {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[method](data)


def _expand(data: bytes, method: int, size: int) -> bytes:
    if method in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if method not in (NONE, PACKBITS, LZW):
        raise ValueError(f"compression {method}")
    return {NONE: lambda d, n: d, PACKBITS: packbits_decode, LZW: lzw_decode}[method](data, size)


def write_tiff(payload: bytes, method: int = DEFLATE, predictor: int = 1, tiled: bool = False, order: str = "<") -> bytes:
    """Bytes whose number is a positive multiple of LINE as 8-bit grey pages of at most PAGE_LINES lines."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for at in range(0, len(payload), LINE * PAGE_LINES):
        image = np.frombuffer(payload[at : at + LINE * PAGE_LINES], np.uint8).reshape(-1, LINE)
        height, step = len(image), TILE if tiled else STRIP_LINES
        parts = []
        for top in range(0, height, step):
            block = image[top : top + step]
            if tiled and len(block) < TILE:
                block = np.concatenate([block, np.zeros((TILE - len(block), LINE), np.uint8)])
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], 1)
            parts.append(_compress(block.tobytes(), method))
        places = []
        for p in parts:
            places.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        sizes = [len(p) for p in parts]
        lists = {}
        for tag, values in ((TILE_OFFSETS if tiled else STRIP_OFFSETS, places), (TILE_BYTES if tiled else STRIP_BYTES, sizes)):
            if len(values) == 1:
                lists[tag] = (4, 1, values[0])
            else:
                lists[tag] = (4, len(values), len(out))
                out += struct.pack(f"{order}{len(values)}I", *values)
        fields = {WIDTH: (4, 1, LINE), HEIGHT: (4, 1, height), BITS: (3, 1, 8), COMPRESSION: (3, 1, method), PHOTOMETRIC: (3, 1, 1), SAMPLES: (3, 1, 1), PREDICTOR: (3, 1, predictor), **lists}
        fields |= {TILE_WIDTH: (4, 1, TILE), TILE_HEIGHT: (4, 1, TILE)} if tiled else {ROWS_PER_STRIP: (4, 1, STRIP_LINES)}
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag in sorted(fields):
            kind, n, value = fields[tag]
            short = struct.pack(order + "HH", value, 0) if kind == 3 and n == 1 else struct.pack(order + "I", value)
            out += struct.pack(order + "HHI", tag, kind, n) + short
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    """Whole-number fields of the directory at ``at``, and where the next one is."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter:
            place = at + 10 + 12 * k
            if count * TYPE_BYTES[kind] > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, f: dict[int, list[int]]) -> dict:
    one = lambda tag, usual: f.get(tag, [usual])[0]
    width, height, samples, bits, method, predictor = f[WIDTH][0], f[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    planar = one(PLANAR, 1)
    if predictor not in {1: (1,), 2: (1,), 4: (1,), 8: (1, 2), 16: (1, 2, 3), 32: (1, 2, 3)}.get(bits, ()) or planar not in (1, 2) or bits < 8 and one(FILL_ORDER, 1) != 1 or len(set(f.get(BITS, [1]))) > 1:
        raise ValueError(f"{f.get(BITS, [1])} bits, predictor {predictor}, planar {planar}, fill order {one(FILL_ORDER, 1)}")
    kind = np.dtype(np.uint8 if bits <= 8 else f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in f
    across, down = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    image = np.zeros((height, width, samples), kind)
    columns, per = -(-width // across), 1 if planar == 2 else samples
    row, parts = -(-across * per * bits // 8), columns * -(-height // down)
    for k, (place, size) in enumerate(zip(f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_BYTES if tiled else STRIP_BYTES])):
        plane, k = divmod(k, parts) if planar == 2 else (0, k)
        top, left = k // columns * down, k % columns * across
        lines = down if tiled else min(down, height - top)
        raw = np.frombuffer(_expand(data[place : place + size], method, lines * row), np.uint8, lines * row).reshape(lines, row)
        if bits < 8:
            block = np.unpackbits(raw, axis=1)[:, : across * per * bits].reshape(lines, across, per, bits) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
        elif predictor == 3:  # bytes of a line by their place in the sample, highest first, as differences
            held = np.cumsum(raw.reshape(lines, -1, per), axis=1, dtype=np.uint8).reshape(lines, bits // 8, across * per)
            block = np.ascontiguousarray(held.transpose(0, 2, 1)).view(f">u{bits // 8}").reshape(lines, across, per)
        else:
            block = raw.view(kind).reshape(lines, across, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        image[top : top + lines, left : left + across, plane : plane + per] = block[: height - top, : width - left]
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": method, "predictor": predictor, "pixels": image.tobytes(), "problem": None}


def read_pages(data: bytes | None) -> list[dict]:
    """All pages of a TIFF value; damaged or unknown ones have ``problem`` and no pixels, what can be read is read."""
    pages, seen = [], set()
    try:
        order = {b"II": "<", b"MM": ">"}[(data or b"")[:2]]
        version, at = struct.unpack_from(order + "HI", data, 2)
        if version != 42:
            raise ValueError(f"version {version}")
        while at and at not in seen:
            seen.add(at)
            fields, following = _fields(data, order, at)
            try:
                pages.append(_page(data, order, fields))
            except (ValueError, KeyError, IndexError, TypeError, MemoryError, struct.error, zlib.error) as e:
                pages.append({"problem": f"{type(e).__name__}: {e}"})
            at = following
    except (ValueError, KeyError, struct.error) as e:
        pages.append({"problem": f"{type(e).__name__}: {e}"})
    return [{"page": k, "pages": len(pages), **p} for k, p in enumerate(pages)]


_NAMES = [x.split(" ")[0] for x in PAGE.split(", ")]
_TYPES = [pa.int32()] * 8 + [pa.binary(), pa.string()]


def _explode(media: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                found = [read_pages(x) for x in part.column(media).to_pylist()]
                owner = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                rows = [p for x in found for p in x]
                kept = [part.column(c).take(owner) for c in part.schema.names if c != media]
                yield pa.RecordBatch.from_arrays(kept + [pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)],
                                                 [c for c in part.schema.names if c != media] + _NAMES)

    return run


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row a page of the TIFF files in column ``media``: page (from 0), pages, sizes, pixels (rows top down, native samples), problem.

    Other columns are carried along, except those named as the page columns. A null or foreign value gives one row with a
    problem. Pages of a row stay together and in order.
    """
    kept = [c for c in df.columns if c != media and c not in _NAMES]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept) + PAGE
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{media}`").alias(media)).mapInArrow(_explode(media), schema)


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(LINE, -(-len(data) // LINE) * LINE) - len(data))


def form_of(payload: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and layout by the payload's checksum: mostly deflate, now and then LZW or PackBits, every other one predicted, some tiled."""
    c = zlib.crc32(payload)
    return {0: LZW, 1: PACKBITS}.get(c % 16, DEFLATE), 1 + (c >> 8) % 2, (c >> 16) % 4 == 0


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            forms = [payload_of(x) for x in part.column("text").to_pylist()]
            media = [write_tiff(p, *form_of(p)) for _, p in forms]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for n, _ in forms], pa.int64()), pa.array([len(x) for x in media], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media_bytes", "media_sha256", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, media): each whole text as a TIFF file; null texts are empty."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, media binary")


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages int"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["problem"]:
                raise ValueError(f"a stored page can't be read: {r['problem']}")
            held.append(r["pixels"])
            if r["page"] + 1 < r["pages"]:
                continue
            data, held = b"".join(held), []
            counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            mean = float(counts @ np.arange(256)) / len(data)
            spread = float(np.sqrt(max(0.0, counts @ np.arange(256.0) ** 2 / len(data) - mean * mean)))
            p = counts[counts > 0] / len(data)
            feature = f"{LINE}x{len(data) // LINE}/{r['pages']} mean {mean:.4f} spread {spread:.4f} entropy {float(-(p * np.log2(p)).sum()):.4f}"
            rows.append((r["doc_id"], r["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), r["media_bytes"], r["media_sha256"], feature, r["pages"]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], [x.split(" ")[0] for x in FEATURES.split(", ")])


def features(pages: DataFrame) -> DataFrame:
    """Features of each stored file from its pages, which ``tiff_pages`` leaves side by side: no shuffle of pixels."""
    return pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pages", "pixels", "problem").mapInArrow(_digest, FEATURES)
