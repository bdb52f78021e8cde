"""PNG: chunks as Column expressions, a writer with filter choice and reduction hints, and a reader for its output."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type codes with samples a pixel and legal depths.
COLOURS = {"gray": (0, 1, (1, 2, 4, 8, 16)), "rgb": (2, 3, (8, 16)), "palette": (3, 1, (1, 2, 4, 8)), "gray_alpha": (4, 2, (8, 16)), "rgba": (6, 4, (8, 16))}
MOST_IDAT = 1 << 16


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def chunk_column(kind: str, data: Column) -> Column:
    """The same as a Column: length, kind, data and CRC-32, all native."""
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    tagged = F.concat(F.lit(kind.encode()), data)
    return F.concat(word(F.length(data)), tagged, word(F.crc32(tagged)))


def ihdr_column(width: Column, height: Column, depth: int, colour: str) -> Column:
    """The 13-byte header as a Column."""
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    code, _, depths = COLOURS[colour]
    if depth not in depths:
        raise ValueError(f"{colour} has no depth of {depth} bits")
    return F.concat(word(width), word(height), F.lit(bytes([depth, code, 0, 0, 0])))


def filtered(samples: np.ndarray, bpp: int, strategy: str = "min_sum_abs") -> bytes:
    """Rows of bytes (rows, row bytes), each with its filter's number before it."""
    rows = samples.astype(np.int16)
    up = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, bpp:], corner[:, bpp:] = rows[:, :-bpp], up[:, :-bpp]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    each = np.stack([rows, rows - left, rows - up, rows - (left + up) // 2, rows - paeth]) % 256
    if strategy.isdigit():
        best = np.full(len(rows), int(strategy))
    else:
        best = np.minimum(each, (256 - each) % 256).sum(axis=2).argmin(axis=0)
    picked = each[best, np.arange(len(rows))].astype(np.uint8)
    return np.column_stack([best.astype(np.uint8), picked]).tobytes()


# Ancillary chunks, each (kind, data). Those of _BEFORE stand before the palette, the rest after it.

_BEFORE = (b"cHRM", b"gAMA", b"iCCP", b"sBIT", b"sRGB")


def gamma(value: float) -> tuple[bytes, bytes]:
    return b"gAMA", struct.pack(">I", round(value * 100_000))


def srgb(intent: int = 0) -> tuple[bytes, bytes]:
    return b"sRGB", bytes([intent])


def chromaticities(white: tuple[float, float], *primaries: tuple[float, float]) -> tuple[bytes, bytes]:
    return b"cHRM", struct.pack(">8I", *(round(v * 100_000) for xy in (white, *primaries) for v in xy))


def significant_bits(*bits: int) -> tuple[bytes, bytes]:
    return b"sBIT", bytes(bits)


def background(*samples: int, indexed: bool = False) -> tuple[bytes, bytes]:
    return b"bKGD", bytes(samples) if indexed else struct.pack(f">{len(samples)}H", *samples)


def physical(x: int, y: int, metres: bool = True) -> tuple[bytes, bytes]:
    return b"pHYs", struct.pack(">IIB", x, y, metres)


def time(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> tuple[bytes, bytes]:
    return b"tIME", struct.pack(">HBBBBB", year, month, day, hour, minute, second)


def text(keyword: str, value: str, *, compressed: bool = False) -> tuple[bytes, bytes]:
    """Latin-1 text as tEXt or zTXt, anything else as iTXt."""
    key = keyword.encode("latin-1")
    if not 1 <= len(key) <= 79:
        raise ValueError("PNG: a keyword has 1 to 79 bytes")
    try:
        plain = value.encode("latin-1")
    except UnicodeEncodeError:
        body = value.encode()
        return b"iTXt", key + b"\0" + bytes([compressed, 0]) + b"\0\0" + (zlib.compress(body) if compressed else body)
    return (b"zTXt", key + b"\0\0" + zlib.compress(plain)) if compressed else (b"tEXt", key + b"\0" + plain)


def icc_profile(name: str, profile: bytes) -> tuple[bytes, bytes]:
    return b"iCCP", name.encode("latin-1") + b"\0\0" + zlib.compress(profile)


def exif(data: bytes) -> tuple[bytes, bytes]:
    return b"eXIf", data


def xmp(packet: str) -> tuple[bytes, bytes]:
    return b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + packet.encode()


def encode(samples: np.ndarray, colour: str, *, depth: int = 8, strategy: str = "min_sum_abs", level: int = 6, palette: bytes = b"", alphas: bytes = b"", extra: Sequence[tuple[bytes, bytes]] = ()) -> bytes:
    """``samples``: (rows, columns, samples a pixel). ``brute_force`` tries every filter and keeps the smallest."""
    code, parts, depths = COLOURS[colour]
    if depth not in depths or samples.shape[2] != parts:
        raise ValueError("PNG: samples don't fit the colour type")
    rows, width, _ = samples.shape
    if depth == 16:
        flat = samples.astype(">u2").view(np.uint8).reshape(rows, -1)
    elif depth < 8:
        flags = ((samples.reshape(rows, width, 1).astype(np.int64) >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8)
        flat = np.packbits(flags.reshape(rows, -1), axis=1)
    else:
        flat = samples.astype(np.uint8).reshape(rows, -1)
    bpp = max(1, parts * depth // 8)
    tried = ["min_sum_abs", "0", "1", "2", "3", "4"] if strategy == "brute_force" else [strategy]
    body = min((zlib.compress(filtered(flat, bpp, x), level) for x in tried), key=len)
    out = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, depth, code, 0, 0, 0))]
    out += [chunk(k, v) for k, v in extra if k in _BEFORE]
    if palette:
        out.append(chunk(b"PLTE", palette))
    if alphas:
        out.append(chunk(b"tRNS", alphas))
    out += [chunk(k, v) for k, v in extra if k not in _BEFORE]
    out += [chunk(b"IDAT", body[k : k + MOST_IDAT]) for k in range(0, len(body), MOST_IDAT)]
    return b"".join([*out, chunk(b"IEND", b"")])


def decode(raw: bytes) -> tuple[np.ndarray, dict[str, bytes]]:
    """Samples and the chunks before them; CRCs are checked."""
    if raw[:8] != SIGNATURE:
        raise ValueError("PNG: bad signature")
    at, known, data = 8, {}, b""
    while at < len(raw):
        if at + 12 > len(raw):
            raise ValueError("PNG: truncated")
        n, kind = struct.unpack_from(">I4s", raw, at)
        part = raw[at + 8 : at + 8 + n]
        if len(part) != n or zlib.crc32(kind + part) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise ValueError("PNG: a chunk is damaged")
        if kind == b"IDAT":
            data += part
        else:
            known[kind.decode()] = part
        at += 12 + n
    width, rows, depth, code = struct.unpack_from(">IIBB", known["IHDR"])
    parts = next(v[1] for v in COLOURS.values() if v[0] == code)
    stored, bpp = (width * parts * depth + 7) // 8, max(1, parts * depth // 8)
    plain = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, stored + 1)
    out = np.zeros((rows + 1, stored + bpp), np.int64)
    for y in range(rows):
        row, up, kind = plain[y, 1:].astype(np.int64), out[y], plain[y, 0]
        own = out[y + 1]
        if kind in (0, 2):
            own[bpp:] = row + (up[bpp:] if kind == 2 else 0)
        else:
            for i in range(stored):
                a, b, c = int(own[i]), int(up[i + bpp]), int(up[i])
                p = a + b - c
                guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i + bpp] = (row[i] + guess) & 255
        own &= 255
    flat = out[1:, bpp:].astype(np.uint8)
    if depth == 16:
        return flat.copy().view(">u2").reshape(rows, width, parts).astype(np.uint16), known
    if depth < 8:
        flags = np.unpackbits(flat, axis=1)[:, : width * depth].reshape(rows, width, depth)
        return (flags.astype(np.int64) << np.arange(depth - 1, -1, -1)).sum(axis=2)[:, :, None].astype(np.uint8), known
    return flat.reshape(rows, width, parts), known
