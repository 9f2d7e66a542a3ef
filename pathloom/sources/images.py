"""Image bytes to arrays and back: PNG and TIFF as microscopes write them, with the standard library and numpy.

PNG: 8 or 16 bits; gray, gray with alpha, RGB, RGBA or palette; not interlaced. TIFF: pages of strips, 8 or 16 bits, one or
three samples, uncompressed or deflated, either byte order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(image: np.ndarray) -> bytes:
    """A gray (h, w) or RGB (h, w, 3) array of unsigned 8- or 16-bit values as PNG."""
    depth = 16 if image.dtype == np.uint16 else 8
    colour = 0 if image.ndim == 2 else 2
    h, w = image.shape[:2]
    rows = image.astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters; ``raw`` has the filter's number before each row, ``step`` is the bytes of a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            own, up = row.tolist(), above.tolist()
            for i in range(len(own)):
                a, b = own[i - step] if i >= step else 0, up[i]
                if kind == 3:
                    own[i] = (own[i] + (a + b) // 2) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    own[i] = (own[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            row[:] = own
        above = row
    return rows


def read_png(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, samples) of uint8 or uint16; a palette is resolved to RGB."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        own = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"PLTE":
            palette = np.frombuffer(own, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(own)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    if interlaced or depth not in (8, 16):
        raise ValueError("interlaced or packed PNGs are not read")
    samples = _SAMPLES[colour]
    step = samples * depth // 8
    rows = _unfilter(np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step), step)
    image = rows.view(">u2").astype(np.uint16) if depth == 16 else rows
    image = image.reshape(h, w, samples)
    if colour == 3:
        return palette[image[:, :, 0]]
    return image[:, :, 0] if samples == 1 else image


def write_tiff(pages: list[np.ndarray]) -> bytes:
    """Gray pages of uint8 or uint16 as an uncompressed little-endian TIFF."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        h, w = page.shape
        raw, at = page.astype(page.dtype.newbyteorder("<")).tobytes(), len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, w), (257, 4, h), (258, 3, page.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, h), (279, 4, len(raw))]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The pages in order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in sizes:
                code, size = sizes[kind]
                where = at + 10 + 12 * i
                if count * size > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        w, h, bits, samples = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(277, (1,))[0]
        if bits not in (8, 16) or tags.get(284, (1,))[0] != 1 or tags.get(317, (1,))[0] != 1:
            raise ValueError("only 8- or 16-bit chunky pages without a predictor are read")
        unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress}.get(tags.get(259, (1,))[0])
        if unpack is None:
            raise ValueError("unknown compression")
        raw = b"".join(unpack(data[o : o + c]) for o, c in zip(tags[273], tags[279]))
        page = np.frombuffer(raw, f"{order}u{bits // 8}").astype(np.uint8 if bits == 8 else np.uint16).reshape(h, w, samples)
        yield page[:, :, 0] if samples == 1 else page
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode(data: bytes) -> list[np.ndarray]:
    """All images in a file: one of a PNG, the pages of a TIFF."""
    return [read_png(data)] if data[:8] == _MAGIC else list(read_tiff(data))
