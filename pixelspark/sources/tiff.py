"""TIFF: directories of typed tags as rows, strips as splits, and a baseline reader and writer.

Classic and BigTIFF, both byte orders. Samples are 8 bits, gray, RGB, RGBA, CMYK or indices of a palette, in strips or
tiles, plain or compressed by PackBits, LZW or DEFLATE, with or without horizontal differencing; bilevel strips may be
Modified Huffman or Group 4.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import codecs

#: Field types (code: name, bytes, struct format).
TYPES = {
    1: ("byte", 1, "B"), 2: ("ascii", 1, "s"), 3: ("short", 2, "H"), 4: ("long", 4, "I"), 5: ("rational", 8, "II"), 6: ("sbyte", 1, "b"),
    7: ("undefined", 1, "s"), 8: ("sshort", 2, "h"), 9: ("slong", 4, "i"), 10: ("srational", 8, "ii"), 11: ("float", 4, "f"), 12: ("double", 8, "d"),
    16: ("long8", 8, "Q"), 17: ("slong8", 8, "q"), 18: ("ifd8", 8, "Q"),
}
#: Compression schemes and photometric interpretations by code.
COMPRESSIONS = {1: "none", 2: "mh", 3: "group3", 4: "g4", 5: "lzw", 6: "old_jpeg", 7: "jpeg", 8: "deflate", 32946: "deflate", 32773: "packbits"}
PHOTOMETRICS = {0: "white_is_zero", 1: "black_is_zero", 2: "rgb", 3: "palette", 4: "mask", 5: "cmyk", 6: "ycbcr", 8: "cielab", 32803: "cfa", 34892: "linear_raw"}
MOST_DIRECTORIES = 65_536
MOST_IMAGE = 64 << 20
_SUB = 330


class Reader:
    """The directories of one file. Unknown field types are skipped; of a repeated tag the last counts."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        if raw[:2] not in (b"II", b"MM"):
            raise ValueError("TIFF: no byte order")
        self.order = "<" if raw[:2] == b"II" else ">"
        magic = self._unpack("H", 2)
        if magic == 42:
            self.big, self.first = False, self._unpack("I", 4)
        elif magic == 43 and self._unpack("H", 4) == 8 and self._unpack("H", 6) == 0:
            self.big, self.first = True, self._unpack("Q", 8)
        else:
            raise ValueError("TIFF: bad magic")

    def _unpack(self, kind: str, at: int):  # noqa: ANN202
        try:
            return struct.unpack_from(self.order + kind, self.raw, at)[0]
        except struct.error as e:
            raise ValueError("TIFF: truncated") from e

    def directory(self, at: int) -> tuple[dict[int, tuple[str, list]], int]:
        """Tags of the directory at an offset (type name, values), and the offset of the next."""
        word, entry, inline = ("Q", 20, 8) if self.big else ("I", 12, 4)
        count, at = self._unpack("Q" if self.big else "H", at), at + (8 if self.big else 2)
        if count * entry > len(self.raw):
            raise ValueError("TIFF: a directory is larger than the file")
        out = {}
        for k in range(count):
            place = at + k * entry
            tag, kind, n = self._unpack("H", place), self._unpack("H", place + 2), self._unpack(word, place + 4)
            if kind not in TYPES:
                continue
            name, size, form = TYPES[kind]
            where = place + 4 + struct.calcsize(word)
            if n * size > inline:
                where = self._unpack(word, where)
            part = self.raw[where : where + n * size]
            if len(part) != n * size:
                raise ValueError("TIFF: a value is outside the file")
            if form == "s":
                values: list = [part]
            else:
                flat = struct.unpack(f"{self.order}{n * len(form)}{form[0]}", part)
                values = list(zip(flat[::2], flat[1::2], strict=True)) if len(form) == 2 else list(flat)
            out[tag] = (name, values)
        return out, self._unpack(word, at + count * entry)

    def directories(self) -> Iterator[tuple[str, dict[int, tuple[str, list]]]]:
        """Every directory with its path: ``0``, ``1`` along the chain, ``0/0`` below; loops end the walk."""
        seen: set[int] = set()

        def walk(at: int, prefix: str) -> Iterator[tuple[str, dict]]:
            k = 0
            while at:
                if at in seen or len(seen) >= MOST_DIRECTORIES:
                    raise ValueError("TIFF: directories form a loop")
                seen.add(at)
                tags, at = self.directory(at)
                yield f"{prefix}{k}", tags
                for j, sub in enumerate(tags.get(_SUB, ("", []))[1]):
                    yield from walk(sub, f"{prefix}{k}/{j}/")
                k += 1

        return walk(self.first, "")


def read_page(raw: bytes, page: int = 0) -> np.ndarray:
    """The samples (rows, columns, samples a pixel) of a page; bilevel pages give 0 and 1, black_is_zero or not. A
    missing or malformed tag raises ``ValueError``."""
    try:
        return _read_page(raw, page)
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError("TIFF: a tag is missing or malformed") from e


def _read_page(raw: bytes, page: int) -> np.ndarray:
    pages = [tags for path, tags in Reader(raw).directories() if "/" not in path]
    if page >= len(pages):
        raise ValueError("TIFF: no such page")
    tags = pages[page]
    one = lambda tag, default=None: tags[tag][1][0] if tag in tags else default
    width, rows = one(256), one(257)
    if not width or not rows:
        raise ValueError("TIFF: no dimensions")
    bits, spp, scheme, predictor = one(258, 1), one(277, 1), COMPRESSIONS.get(one(259, 1)), one(317, 1)
    per_strip = min(one(278, rows), rows)
    if width * rows * spp > MOST_IMAGE or bits not in (1, 8):
        raise ValueError("TIFF: unsupported size or depth")
    stored = (width * spp * bits + 7) // 8
    if 322 in tags:
        if bits != 8:
            raise ValueError("TIFF: tiles have 8 bits a sample")
        samples = _tiles(raw, tags, rows, width, spp, scheme, predictor)
    else:
        out = []
        offsets, counts = tags[273][1], tags[279][1]
        if len(offsets) != -(-rows // per_strip) or len(counts) != len(offsets):
            raise ValueError("TIFF: wrong number of strips")
        for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
            own = min(per_strip, rows - k * per_strip)
            out.append(_plain(raw[at : at + n], own, stored, width, bits, scheme))
        whole = b"".join(out)
        if bits == 1:
            return codecs.unpack_rows(whole, rows, width, 1)[:, :, None].astype(np.uint8)
        samples = np.frombuffer(whole, np.uint8).reshape(rows, width, spp)
        samples = np.cumsum(samples, axis=1, dtype=np.uint64).astype(np.uint8) if predictor == 2 else samples
    if one(262) == 3:
        table = np.array(tags[320][1]).reshape(3, -1).T >> 8
        return table[samples[..., 0]].astype(np.uint8)
    return samples


def _plain(part: bytes, rows: int, stored: int, width: int, bits: int, scheme: str | None) -> bytes:
    """The bytes of a strip or tile."""
    if scheme == "none":
        plain = part[: rows * stored]
    elif scheme in ("packbits", "lzw"):
        plain = (codecs.packbits_decode if scheme == "packbits" else codecs.lzw_decode)(part, rows * stored)
    elif scheme in ("mh", "g4") and bits == 1:
        plain = (codecs.mh_decode if scheme == "mh" else codecs.g4_decode)(part, rows, width)
    elif scheme == "deflate":
        plain = codecs.inflate(part)
    else:
        raise ValueError("TIFF: unsupported compression")
    if len(plain) != rows * stored:
        raise ValueError("TIFF: a strip is truncated")
    return plain


def _tiles(raw: bytes, tags: dict, rows: int, width: int, spp: int, scheme: str | None, predictor: int) -> np.ndarray:
    wide, tall = tags[322][1][0], tags[323][1][0]
    across, down = -(-width // wide), -(-rows // tall)
    offsets, counts = tags[324][1], tags[325][1]
    if len(offsets) != across * down or len(counts) != len(offsets) or wide * tall * spp > MOST_IMAGE:
        raise ValueError("TIFF: wrong number of tiles")
    out = np.zeros((down * tall, across * wide, spp), np.uint8)
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        y, x = divmod(k, across)
        tile = np.frombuffer(_plain(raw[at : at + n], tall, wide * spp, wide, 8, scheme), np.uint8).reshape(tall, wide, spp)
        out[y * tall : (y + 1) * tall, x * wide : (x + 1) * wide] = np.cumsum(tile, axis=1, dtype=np.uint64).astype(np.uint8) if predictor == 2 else tile
    return out[:rows, :width]


def write_pages(
    pages: list[np.ndarray], *, compression: str = "none", predictor: bool = False, big_endian: bool = False, big: bool = False, strip_bytes: int = 8192, tile: tuple[int, int] | None = None, palette: np.ndarray | None = None, cmyk: bool = False
) -> bytes:
    """Pages of 8-bit samples (rows, columns, 1, 3 or 4 samples), or of bits with ``mh`` or ``g4``, as one file, in
    strips or in tiles of (rows, columns), multiples of 16. ``palette``: RGB rows that gray pages index."""
    order, word = (">" if big_endian else "<"), ("Q" if big else "I")
    code = {v: k for k, v in reversed(COMPRESSIONS.items())}[compression]
    bits = 1 if compression in ("mh", "g4") else 8
    if tile and (tile[0] % 16 or tile[1] % 16 or bits == 1):
        raise ValueError("TIFF: tiles are multiples of 16, of 8-bit samples")
    out = bytearray(b"MM" if big_endian else b"II")
    out += struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0)))
    link = len(out) - struct.calcsize(word)
    for k, page in enumerate(pages):
        rows, width, spp = page.shape
        stored = (width * spp * bits + 7) // 8
        per_strip = max(1, strip_bytes // stored)
        if tile:
            tall, wide = tile
            padded = np.zeros((-(-rows // tall) * tall, -(-width // wide) * wide, spp), np.uint8)
            padded[:rows, :width] = page
            parts = [padded[y : y + tall, x : x + wide] for y in range(0, rows, tall) for x in range(0, width, wide)]
        else:
            parts = [page[y : y + per_strip] for y in range(0, rows, per_strip)]
        offsets, counts = [], []
        for part in parts:
            data = _block(part, compression, predictor, bits)
            out += b"\0" * (len(out) & 1)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        photometric = 0 if bits == 1 else 3 if palette is not None else 1 if spp == 1 else 5 if cmyk else 2
        tags: list[tuple[int, int, list]] = [
            (254, 4, [2 if len(pages) > 1 else 0]), (256, 4, [width]), (257, 4, [rows]), (258, 3, [bits] * spp), (259, 3, [code]), (262, 3, [photometric]),
            (277, 3, [spp]), (282, 5, [(72, 1)]), (283, 5, [(72, 1)]), (296, 3, [2]),
        ]
        if tile:
            tags += [(322, 4, [wide]), (323, 4, [tall]), (324, 4, offsets), (325, 4, counts)]
        else:
            tags += [(273, 4, offsets), (278, 4, [per_strip]), (279, 4, counts)]
        if len(pages) > 1:
            tags.append((297, 3, [k, len(pages)]))
        if predictor and bits == 8:
            tags.append((317, 3, [2]))
        if palette is not None:
            table = np.zeros((256, 3), np.int64)
            table[: len(palette)] = palette
            tags.append((320, 3, (table * 257).T.reshape(-1).tolist()))
        if spp == 4 and not cmyk:
            tags.append((338, 3, [2]))
        link = write_directory(out, tags, order, big, link)
    return bytes(out)


def _block(part: np.ndarray, compression: str, predictor: bool, bits: int) -> bytes:
    """A strip or tile as it stands in the file."""
    width = part.shape[1]
    if predictor and bits == 8:
        part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
    plain = codecs.pack_rows(part[:, :, 0], 1) if bits == 1 else part.tobytes()
    stored = len(plain) // max(len(part), 1)
    if compression == "packbits":
        return b"".join(codecs.packbits_encode(plain[a : a + stored]) for a in range(0, len(plain), stored))
    work = {"none": lambda x: x, "lzw": codecs.lzw_encode, "deflate": codecs.deflate, "mh": lambda x: codecs.mh_encode(x, width), "g4": lambda x: codecs.g4_encode(x, width)}
    return work[compression](plain)


def write_directory(out: bytearray, tags: list[tuple[int, int, list]], order: str, big: bool, link: int) -> int:
    """Appends a directory, sorted by tag, with its long values before it; returns where the next one's offset goes."""
    word, inline = ("Q", 8) if big else ("I", 4)
    entries = []
    for tag, kind, values in sorted(tags):
        form = TYPES[kind][2]
        if form == "s":
            data, n = values[0], len(values[0])
        else:
            flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
            data, n = struct.pack(f"{order}{len(flat)}{form[0]}", *flat), len(values)
        if len(data) > inline:
            out += b"\0" * (len(out) & 1)
            at = len(out)
            out += data
            data = struct.pack(order + word, at)
        entries.append(struct.pack(f"{order}HH{word}", tag, kind, n) + data.ljust(inline, b"\0"))
    out += b"\0" * (len(out) & 1)
    out[link : link + struct.calcsize(word)] = struct.pack(order + word, len(out))
    out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
    out += struct.pack(order + word, 0)
    return len(out) - struct.calcsize(word)


_TAG_SCHEMA = "path string, ifd string, tag int, type string, count long, ints array<long>, rationals array<struct<num:long,den:long>>, floats array<double>, bytes binary, error string"


def read_tags(files: DataFrame, *, mode: str = "permissive") -> DataFrame:
    """``files`` (path, content) to a row for each tag of each directory, without reading pixels. A malformed file
    gives one row with its error, or fails the job with ``mode="failfast"``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("num", pa.int64()), ("den", pa.int64())]))
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pair, pa.list_(pa.float64()), pa.binary(), pa.string()]
        names = [x.split()[0] for x in _TAG_SCHEMA.replace("struct<num:long,den:long>", "pair").split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    own = []
                    for ifd, tags in Reader(raw or b"").directories():
                        for tag, (kind, values) in sorted(tags.items()):
                            text, pairs, real = kind in ("ascii", "undefined"), kind in ("rational", "srational"), kind in ("float", "double")
                            own.append((path, ifd, tag, kind, len(values[0]) if text else len(values), None if text or pairs or real else values, [{"num": a, "den": b} for a, b in values] if pairs else None, values if real else None, values[0] if text else None, None))
                    out += own
                except ValueError as e:
                    if mode == "failfast":
                        raise
                    out.append((path, *[None] * 8, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    return files.select("path", "content").mapInArrow(run, _TAG_SCHEMA)
