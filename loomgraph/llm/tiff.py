"""Baseline TIFF in pure Python and numpy: reading and writing."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_INTS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, END = 256, 257


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(?s)(.)\1{2,}", data):
        literal(data[at : m.start()])
        n = m.end() - m.start()
        while n:
            k = min(n, 128)
            out.extend((257 - k & 255, data[m.start()])) if k > 1 else out.extend((0, data[m.start()]))
            n -= k
        at = m.end()
    literal(data[at:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, held, n_held = bytearray(), 0, 0
    known, width, word = {bytes([i]): i for i in range(256)}, 9, b""

    def put(code: int) -> None:
        nonlocal held, n_held
        held, n_held = held << width | code, n_held + width
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held & 255)
            held &= (1 << n_held) - 1

    put(CLEAR)
    following = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = following
        following += 1
        if following == 4094:
            put(CLEAR)
            known, width, following = {bytes([j]): j for j in range(256)}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(known[word])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if n_held:
        out.append(held << 8 - n_held & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, table, width = bytearray(), [], 9
    held = n_held = 0
    last = b""
    for byte in data:
        held, n_held = held << 8 | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code = held >> n_held
        held &= (1 << n_held) - 1
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == END or len(out) >= size:
            break
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def _packed(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: packbits, LZW: lzw}[compression](data)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    raise ValueError(f"compression {compression} is not supported")


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_bytes: int = 1 << 16, order: str = "<") -> bytes:
    """8- or 16-bit images (rows x columns, or rows x columns x samples), a page each; in strips, or in tiles of tile x tile pixels."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        if image.ndim == 2:
            image = image[:, :, None]
        rows, columns, samples = image.shape
        wide = image.dtype.itemsize
        if tile:
            across, down = -(-columns // tile), -(-rows // tile)
            padded = np.zeros((down * tile, across * tile, samples), image.dtype)
            padded[:rows, :columns] = image
            parts = [padded[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            per = max(1, strip_bytes // max(1, columns * samples * wide))
            parts = [image[y : y + per] for y in range(0, rows, per)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            packed = _packed(part.astype(part.dtype.newbyteorder(order)).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [8 * wide] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [per]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_INTS[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    index: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # rows x columns x samples


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and the integer tags of each image directory, in the chain's order. A chain that comes back ends; a damaged one raises after the good directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            e = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, e)
            if kind in _INTS:
                where = e + 8 if _SIZES[kind] * count <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_INTS[kind]}", data, where))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pages(data: bytes) -> Iterator[Page | Exception]:
    """The pages in order; in the place of a damaged or unsupported one, what is wrong with it. A damaged chain of directories raises at its end."""
    for index, (order, tags) in enumerate(directories(data)):
        try:
            yield page(data, order, index, tags)
        except Exception as e:
            yield e


def page(data: bytes, order: str, index: int, tags: dict[int, list[int]]) -> Page:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    columns, rows, samples, compression, predictor = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits, tiled = one(BITS, 1), TILE_OFFSETS in tags
    if bits not in (8, 16) or predictor not in (1, 2):
        raise ValueError(f"{bits} bits with predictor {predictor} are not supported")
    kind = np.dtype(np.uint8 if bits == 8 else np.uint16).newbyteorder(order)
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    if tiled:
        w, h = one(TILE_WIDTH), one(TILE_LENGTH)
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h = columns, min(rows, one(ROWS_PER_STRIP, rows))
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    across, down = -(-columns // w), -(-rows // h)
    image = np.zeros((rows, columns, samples), kind.newbyteorder("="))
    for i, (at, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * h, rest % across * w
        tall = h if tiled else min(h, rows - y)
        part = np.frombuffer(_unpacked(data[at : at + count], compression, tall * w * each * kind.itemsize), kind).reshape(tall, w, each).astype(image.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=image.dtype)
        image[y : y + h, x : x + w, plane * each : (plane + 1) * each] = part[: rows - y, : columns - x]
    return Page(index, columns, rows, bits, samples, compression, predictor, tiled, image)
