"""Byte codecs: serial inside one blob, parallel over blobs, run as Arrow functions over a binary column.

Encoders and decoders are plain functions from bytes to bytes, written on strings of bits or runs, so that the
interpreter works on whole codes rather than on bits. ``codec`` gives them as Column functions. Malformed input
raises ``ValueError``; as a Column that is null with ``mode="permissive"`` and a failed job with ``"failfast"``.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import Once

# --- bits ---------------------------------------------------------------------------------------------------------


def to_bytes(bits: str) -> bytes:
    """A string of 0 and 1, highest bit first, padded with zeros."""
    bits += "0" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


def to_bits(raw: bytes) -> str:
    return format(int.from_bytes(raw, "big"), f"0{8 * len(raw)}b") if raw else ""


def pack_rows(samples: np.ndarray, bits: int) -> bytes:
    """Rows of samples of ``bits`` bits, highest bit first, each row padded to a byte."""
    places = np.arange(bits - 1, -1, -1)
    flags = ((samples[:, :, None].astype(np.int64) >> places) & 1).astype(np.uint8)
    return np.packbits(flags.reshape(len(samples), -1), axis=1).tobytes()


def unpack_rows(raw: bytes, rows: int, width: int, bits: int) -> np.ndarray:
    stored = (width * bits + 7) // 8
    if len(raw) < rows * stored:
        raise ValueError("packed rows are truncated")
    flags = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stored).reshape(rows, stored), axis=1)[:, : width * bits]
    return (flags.reshape(rows, width, bits).astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2)


def leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 127
        out.append(low | (128 if value else 0))
        if not value:
            return bytes(out)


class LowBits:
    """Writes and reads values with the lowest bit first, as DEFLATE and lossless WebP do."""

    def __init__(self, raw: bytes = b"") -> None:
        self._value, self._size, self._at = int.from_bytes(raw, "little"), 8 * len(raw), 0
        self._parts: list[tuple[int, int]] = []

    def put(self, value: int, size: int) -> None:
        self._parts.append((value, size))

    def finish(self) -> bytes:
        bits = "".join(format(v, f"0{n}b") for v, n in reversed(self._parts) if n)
        return int(bits or "0", 2).to_bytes((len(bits) + 7) // 8, "little")

    def take(self, size: int) -> int:
        if self._at + size > self._size:
            raise ValueError("the bit stream is exhausted")
        found = self._value >> self._at & ((1 << size) - 1)
        self._at += size
        return found


# --- PackBits -----------------------------------------------------------------------------------------------------


def packbits_encode(row: bytes) -> bytes:
    """Runs of two to 128 equal bytes, and literals of up to 128 between them."""
    out, plain = [], bytearray()

    def flush() -> None:
        for at in range(0, len(plain), 128):
            part = plain[at : at + 128]
            out.append(bytes([len(part) - 1]) + part)
        plain.clear()

    for byte, group in itertools.groupby(row):
        left = len(list(group))
        while left:
            n = min(left, 128)
            left -= n
            if n == 1:
                plain.append(byte)
            else:
                flush()
                out.append(bytes([257 - n, byte]))
    flush()
    return b"".join(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(raw):
            raise ValueError("PackBits: truncated")
        head = raw[at]
        if head < 128:
            part = raw[at + 1 : at + 2 + head]
            if len(part) != head + 1:
                raise ValueError("PackBits: truncated literal")
            out += part
            at += head + 2
        elif head == 128:
            at += 1
        else:
            if at + 1 >= len(raw):
                raise ValueError("PackBits: truncated run")
            out += raw[at + 1 : at + 2] * (257 - head)
            at += 2
    if len(out) != size:
        raise ValueError("PackBits: length mismatch")
    return bytes(out)


# --- LZW as TIFF has it: highest bit first, 9 to 12 bits, widths changed one code early -----------------------------

_CLEAR, _END, _FULL = 256, 257, 4094


def lzw_encode(raw: bytes) -> bytes:
    out, width, known, text = [format(_CLEAR, "09b")], 9, {}, b""
    top = _END
    for k in range(len(raw)):
        byte = raw[k : k + 1]
        longer = text + byte
        if len(longer) == 1 or longer in known:
            text = longer
            continue
        out.append(format(known[text] if len(text) > 1 else text[0], f"0{width}b"))
        top += 1
        known[longer] = top
        if top + 1 == 1 << width and width < 12:
            width += 1
        if top + 1 == _FULL:
            out.append(format(_CLEAR, f"0{width}b"))
            known, top, width = {}, _END, 9
        text = byte
    if text:
        out.append(format(known[text] if len(text) > 1 else text[0], f"0{width}b"))
    out.append(format(_END, f"0{width}b"))
    return to_bytes("".join(out))


def lzw_decode(raw: bytes, size: int) -> bytes:
    bits, at, width, out, last = to_bits(raw), 0, 9, bytearray(), None
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    known = list(single)
    while at + width <= len(bits):
        code, at = int(bits[at : at + width], 2), at + width
        if code == _END:
            break
        if code == _CLEAR:
            known, width, last = list(single), 9, None
            continue
        if code < len(known):
            text = known[code]
        elif code == len(known) and last is not None:
            text = last + last[:1]
        else:
            raise ValueError("LZW: code out of range")
        out += text
        if last is not None:
            known.append(last + text[:1])
            if len(known) == (1 << width) - 1 and width < 12:
                width += 1
        last = text
    if len(out) < size:
        raise ValueError("LZW: fewer bytes than expected")
    return bytes(out[:size])


# --- CCITT: Modified Huffman and Group 4 ----------------------------------------------------------------------------

# The run-length codes of ITU-T T.4. White and black 0 to 63, then 64 to 1728 in steps of 64; beyond
# that, 1792 to 2560 in steps of 64 for both.
_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"""
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
_BOTH = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"


@cache
def _run_codes() -> tuple[list[dict[int, str]], list[dict[str, int]]]:
    runs = [*range(64), *range(64, 1729, 64), *range(1792, 2561, 64)]
    codes = [dict(zip(runs, f"{own} {_BOTH}".split(), strict=True)) for own in (_WHITE, _BLACK)]
    return codes, [{code: run for run, code in own.items()} for own in codes]


def _run_bits(length: int, colour: int) -> str:
    codes, out = _run_codes()[0][colour], ""
    while length >= 64:
        part = min(length // 64 * 64, 2560)
        out += codes[part]
        length -= part
    return out + codes[length]


def _take_run(bits: str, at: int, colour: int) -> tuple[int, int]:
    known, total = _run_codes()[1][colour], 0
    while True:
        for size in range(2, 14):
            run = known.get(bits[at : at + size])
            if run is not None and at + size <= len(bits):
                break
        else:
            raise ValueError("CCITT: invalid code")
        at += size
        total += run
        if run < 64:
            return total, at


def _row_changes(row: str) -> list[int]:
    """Places where the colour changes, from white before the row."""
    return [k for k, (a, b) in enumerate(zip("0" + row, row, strict=False)) if a != b]


def mh_encode(raw: bytes, width: int) -> bytes:
    stored, out = (width + 7) // 8, []
    for at in range(0, len(raw), stored):
        row, bits, colour = to_bits(raw[at : at + stored])[:width], "", 0
        edges = [*_row_changes(row), width]
        last = 0
        for edge in edges:
            bits += _run_bits(edge - last, colour)
            last, colour = edge, 1 - colour
        out.append(to_bytes(bits))
    return b"".join(out)


def mh_decode(raw: bytes, rows: int, width: int) -> bytes:
    bits, at, out = to_bits(raw), 0, []
    for _ in range(rows):
        row, colour = "", 0
        while len(row) < width:
            run, at = _take_run(bits, at, colour)
            row += "01"[colour] * run
            colour = 1 - colour
        if len(row) > width:
            raise ValueError("CCITT: a run is longer than its row")
        out.append(to_bytes(row))
        at += -at % 8
    return b"".join(out)


_VERTICAL = {0: "1", 1: "011", -1: "010", 2: "000011", -2: "000010", 3: "0000011", -3: "0000010"}
_MODES = {code: ("v", shift) for shift, code in _VERTICAL.items()} | {"001": ("h", 0), "0001": ("p", 0)}


def _above(changes: list[int], a0: int, colour: int, width: int) -> tuple[int, int]:
    """The next change right of ``a0`` in the row above that turns to the other colour, and the one after it."""
    for k, place in enumerate(changes):
        if place > a0 and (k + 1) % 2 == 1 - colour:
            return place, changes[k + 1] if k + 1 < len(changes) else width
    return width, width


def g4_encode(raw: bytes, width: int) -> bytes:
    stored, out, above = (width + 7) // 8, [], []
    for start in range(0, len(raw), stored):
        own = _row_changes(to_bits(raw[start : start + stored])[:width])
        a0, colour = -1, 0
        while a0 < width:
            ahead = [x for x in own if x > a0] + [width, width]
            b1, b2 = _above(above, a0, colour, width)
            if b2 < ahead[0]:
                out.append("0001")
                a0 = b2
            elif abs(ahead[0] - b1) <= 3:
                out.append(_VERTICAL[ahead[0] - b1])
                a0, colour = ahead[0], 1 - colour
            else:
                out.append("001" + _run_bits(ahead[0] - max(a0, 0), colour) + _run_bits(ahead[1] - ahead[0], 1 - colour))
                a0 = ahead[1]
        above = own
    return to_bytes("".join(out) + "000000000001" * 2)


def g4_decode(raw: bytes, rows: int, width: int) -> bytes:
    bits, at, out, above = to_bits(raw), 0, [], []
    for _ in range(rows):
        row, a0, colour = "", -1, 0
        while a0 < width:
            for size in range(1, 8):
                mode = _MODES.get(bits[at : at + size])
                if mode:
                    break
            else:
                raise ValueError("CCITT: unsupported mode")
            at += size
            b1, b2 = _above(above, a0, colour, width)
            if mode[0] == "p":
                ends = [b2]
            elif mode[0] == "v":
                ends = [min(max(b1 + mode[1], 0), width)]
            else:
                first, at = _take_run(bits, at, colour)
                second, at = _take_run(bits, at, 1 - colour)
                ends = [min(max(a0, 0) + first, width), min(max(a0, 0) + first + second, width)]
            for k, end in enumerate(ends):
                row += "01"[colour ^ k] * (end - len(row))
            a0 = ends[-1]
            colour = 1 - colour if mode[0] == "v" else colour
        out.append(to_bytes(row[:width]))
        above = _row_changes(row[:width])
    return b"".join(out)


# --- lossless JPEG (SOF3), predictor 1, one Huffman table --------------------------------------------------------

# Fifteen categories of four bits and two of five.
_CATEGORY_BITS = [4] * 15 + [5, 5]


@cache
def _category_codes() -> tuple[list[str], dict[str, int]]:
    codes, code, last = [], 0, _CATEGORY_BITS[0]
    for size in _CATEGORY_BITS:
        code <<= size - last
        codes.append(format(code, f"0{size}b"))
        code, last = code + 1, size
    return codes, {c: k for k, c in enumerate(codes)}


def _jpeg_guess(samples: np.ndarray, precision: int) -> np.ndarray:
    """Left; above in the first column; the middle of the range at the first sample."""
    guess = np.empty_like(samples)
    guess[:, 1:] = samples[:, :-1]
    guess[1:, 0] = samples[:-1, 0]
    guess[0, 0] = 1 << (precision - 1)
    return guess


def ljpeg_encode(samples: np.ndarray, precision: int) -> bytes:
    """``samples``: (rows, columns, components), up to 16 bits each."""
    samples = samples.astype(np.int64)
    rows, width, parts = samples.shape
    rest = ((samples - _jpeg_guess(samples, precision) + 32768) % 65536 - 32768).reshape(-1)
    codes, bits = _category_codes()[0], []
    for d in rest.tolist():
        size = 16 if d == -32768 else abs(d).bit_length()
        bits.append(codes[size] + (format((d if d >= 0 else d - 1) & ((1 << size) - 1), f"0{size}b") if 0 < size < 16 else ""))
    text = "".join(bits)
    body = to_bytes(text + "1" * (-len(text) % 8)).replace(b"\xff", b"\xff\x00")
    u16 = lambda v: v.to_bytes(2, "big")
    counts = bytes(_CATEGORY_BITS.count(k) for k in range(1, 17))
    frame = bytes([precision]) + u16(rows) + u16(width) + bytes([parts]) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(parts))
    huffman = b"\x00" + counts + bytes(range(17))
    scan = bytes([parts]) + b"".join(bytes([c + 1, 0]) for c in range(parts)) + b"\x01\x00\x00"
    segment = lambda marker, part: b"\xff" + bytes([marker]) + u16(len(part) + 2) + part
    return b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, huffman) + segment(0xDA, scan) + body + b"\xff\xd9"


def ljpeg_decode(raw: bytes) -> np.ndarray:
    """Samples of a stream with predictor 1; anything else, or damage, raises ``ValueError``."""
    try:
        return _ljpeg_decode(raw)
    except (IndexError, StopIteration) as e:
        raise ValueError("JPEG: truncated") from e


def _ljpeg_decode(raw: bytes) -> np.ndarray:
    if raw[:2] != b"\xff\xd8":
        raise ValueError("JPEG: no start of image")
    at, frame, table, predictor = 2, None, None, 1
    while True:
        if len(raw) < at + 4 or raw[at] != 0xFF:
            raise ValueError("JPEG: bad marker")
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        part = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            frame = (part[0], int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big"), part[5])
        elif marker == 0xC4:
            table, code, values = {}, 0, iter(part[17:])
            for k, n in enumerate(part[1:17]):
                for _ in range(n):
                    table[format(code, f"0{k + 1}b")] = next(values)
                    code += 1
                code <<= 1
        elif marker == 0xDA:
            predictor = part[-3]
            break
    if frame is None or table is None or predictor != 1:
        raise ValueError("JPEG: unsupported")
    precision, rows, width, parts = frame
    end = raw.rfind(b"\xff\xd9")
    bits, at = to_bits(raw[at : end if end > 0 else len(raw)].replace(b"\xff\x00", b"\xff")), 0
    if not 1 <= precision <= 16 or not 0 < rows * width * parts <= len(bits):
        raise ValueError("JPEG: truncated")
    rest = np.empty(rows * width * parts, np.int64)
    for k in range(len(rest)):
        for size in range(1, 17):
            category = table.get(bits[at : at + size])
            if category is not None:
                break
        else:
            raise ValueError("JPEG: invalid code")
        at += size
        if category > 16:
            raise ValueError("JPEG: invalid category")
        if category == 16:
            rest[k] = 32768
        elif category:
            value = int(bits[at : at + category] or "0", 2)
            if at + category > len(bits):
                raise ValueError("JPEG: truncated")
            at += category
            rest[k] = value if value >> (category - 1) else value - (1 << category) + 1
        else:
            rest[k] = 0
    rest = rest.reshape(rows, width, parts)
    # The first column is a running sum down, each row a running sum along: both modulo 65536.
    rest[0, 0] += 1 << (precision - 1)
    rest[:, 0] = np.cumsum(rest[:, 0], axis=0)
    return (np.cumsum(rest, axis=1) % 65536).astype(np.uint16)


# --- DEFLATE ------------------------------------------------------------------------------------------------------

_LEVELS = {"store": 0, "fast": 1, "default": 6, "best": 9}


def deflate(raw: bytes, level: str = "default") -> bytes:
    return zlib.compress(raw, _LEVELS[level])


def inflate(raw: bytes) -> bytes:
    try:
        return zlib.decompress(raw)
    except zlib.error as e:
        raise ValueError(str(e)) from e


def huffman_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Code lengths of at most ``most`` bits; the least counts are doubled up until they fit."""
    import heapq

    symbols = sorted(k for k, n in counts.items() if n)
    if len(symbols) < 2:
        return dict.fromkeys(symbols, 1)
    floor = 1
    while True:
        heap = [(max(counts[k], floor), k, (k,)) for k in symbols]
        heapq.heapify(heap)
        lengths = dict.fromkeys(symbols, 0)
        while len(heap) > 1:
            (m, a, x), (n, b, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in x + y:
                lengths[k] += 1
            heapq.heappush(heap, (m + n, min(a, b), x + y))
        if max(lengths.values()) <= most:
            return lengths
        floor *= 2


def canonical_codes(lengths: dict[int, int]) -> dict[int, str]:
    """Codes in the order of (length, symbol)."""
    out, code, last = {}, 0, 0
    for size, symbol in sorted((n, k) for k, n in lengths.items() if n):
        code <<= size - last
        out[symbol] = format(code, f"0{size}b")
        code, last = code + 1, size
    return out


def kraft(lengths: dict[int, int]) -> float:
    """One for a complete code, less for a code with room, more for none."""
    return sum(2.0**-n for n in lengths.values() if n)


# --- as Columns -----------------------------------------------------------------------------------------------------

_CODECS: dict[str, tuple[Callable[..., bytes], Callable[..., bytes]]] = {
    "packbits": (packbits_encode, packbits_decode), "lzw": (lzw_encode, lzw_decode), "mh": (mh_encode, mh_decode),
    "g4": (g4_encode, g4_decode), "deflate": (deflate, lambda raw, _size: inflate(raw)),
}


def register_codec(name: str, encode: Callable[..., bytes], decode: Callable[..., bytes]) -> None:
    _CODECS[name] = (encode, decode)


@lru_cache(64)
def _function(name: str, decode: bool, args: tuple, mode: str) -> Callable[[Column], Column]:
    work = _CODECS[name][decode]

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        try:
            return work(bytes(raw), *args)
        except ValueError:
            if mode == "failfast":
                raise
            return None

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Once(one)
        for part in parts:
            yield part.map(known, na_action=None)

    return run


def codec(name: str, data: Column, *args: int | str, decode: bool = False, mode: str = "permissive") -> Column:
    """``data`` through a codec; ``args`` are what its function takes beside the bytes."""
    if name not in _CODECS:
        raise ValueError(f"no codec is called {name}")
    return _function(name, decode, args, mode)(data)
