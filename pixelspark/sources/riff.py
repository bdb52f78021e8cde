"""RIFF/WebP containers: chunk rows, the extended header, and assembly."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk kinds by code.
KINDS = {"VP8 ": "lossy", "VP8L": "lossless", "VP8X": "extended", "ALPH": "alpha", "ANIM": "animation", "ANMF": "frame", "ICCP": "icc", "EXIF": "exif", "XMP ": "xmp"}


def chunks(raw: bytes) -> Iterator[tuple[int, str, int, bytes]]:
    """(index, code, size, payload) of each chunk; a missing pad byte at the end is tolerated."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("RIFF: not a WebP file")
    size = struct.unpack_from("<I", raw, 4)[0]
    if not 4 <= size <= len(raw) - 8:
        raise ValueError("RIFF: bad size")
    at, end, k = 12, 8 + size, 0
    while at < end:
        if at + 8 > end:
            raise ValueError("RIFF: truncated chunk header")
        n = struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("RIFF: a chunk is larger than the file")
        yield k, raw[at : at + 4].decode("latin-1"), n, raw[at + 8 : at + 8 + n]
        at, k = at + 8 + n + (n & 1), k + 1


def chunk(code: str, payload: bytes) -> bytes:
    return code.encode("latin-1") + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)


def assemble(parts: list[tuple[str, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(chunk(c, p) for c, p in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def extended_header(width: int, height: int, *, icc: bool = False, alpha: bool = False, exif: bool = False, xmp: bool = False, animation: bool = False) -> bytes:
    flags = icc << 5 | alpha << 4 | exif << 3 | xmp << 2 | animation << 1
    return bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def parse_extended(payload: Column) -> Column:
    """The extended header of a binary column, as a struct; null if it is too short."""
    byte = lambda k: F.conv(F.hex(F.substring(payload, k, 1)), 16, 10).cast("int")
    flag = lambda k: byte(1).bitwiseAND(1 << k) != 0
    size = lambda k: byte(k) + byte(k + 1) * 256 + byte(k + 2) * 65536 + 1
    found = F.struct(size(5).alias("width"), size(8).alias("height"), flag(5).alias("icc"), flag(4).alias("alpha"), flag(3).alias("exif"), flag(2).alias("xmp"), flag(1).alias("animation"))
    return F.when(F.length(payload) >= 10, found)


def _little(payload: Column, at: int, size: int) -> Column:
    """An unsigned integer of ``size`` bytes from place ``at`` (1 is the first)."""
    return sum((F.conv(F.hex(F.substring(payload, at + k, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(size)), F.lit(0).cast("long"))


def parse_lossless(payload: Column) -> Column:
    """Sides, alpha hint and version of a lossless stream's header; null without its signature."""
    word = _little(payload, 2, 4)
    part = lambda at, size: F.shiftright(word, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    found = F.struct((part(0, 14) + 1).cast("int").alias("width"), (part(14, 14) + 1).cast("int").alias("height"), (part(28, 1) == 1).alias("alpha"), part(29, 3).cast("int").alias("version"))
    return F.when((F.length(payload) >= 5) & (F.substring(payload, 1, 1) == F.lit(b"\x2f")), found)


def parse_lossy(payload: Column) -> Column:
    """Frame tag, sides and scales of a lossy key frame; null for other frames or without the start code."""
    tag, w, h = _little(payload, 1, 3), _little(payload, 7, 2), _little(payload, 9, 2)
    bits = lambda v, at, size: F.shiftright(v, at).bitwiseAND(F.lit((1 << size) - 1).cast("long")).cast("int")
    found = F.struct(bits(w, 0, 14).alias("width"), bits(h, 0, 14).alias("height"), bits(w, 14, 2).alias("x_scale"), bits(h, 14, 2).alias("y_scale"), bits(tag, 1, 3).alias("version"), (bits(tag, 4, 1) == 1).alias("shown"), bits(tag, 5, 19).alias("first_size"))
    return F.when((F.length(payload) >= 10) & (bits(tag, 0, 1) == 0) & (F.substring(payload, 4, 3) == F.lit(b"\x9d\x01\x2a")), found)


def read_chunks(files: DataFrame, *, mode: str = "permissive") -> DataFrame:
    """``files`` (path, content, as ``binaryFile`` reads them) to (path, idx, fourcc, size, payload, error); a file
    that is no WebP gives one row with its error, or fails the job with ``mode="failfast"``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(path, *x, None) for x in chunks(raw or b"")]
                except ValueError as e:
                    if mode == "failfast":
                        raise
                    out.append((path, None, None, None, None, str(e)))
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["path", "idx", "fourcc", "size", "payload", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, idx int, fourcc string, size long, payload binary, error string")
