"""DNG: raw mosaics and linear raw images as TIFF trees, with a preview first and the raw image in a sub-directory.

Samples are 8 to 16 bits, packed from the highest bit, plain, deflated, or as one lossless JPEG. Readers take the
first directory, top level or below, that holds a mosaic or a linear raw image.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import codecs
from ..operators.batches import Once, batched
from . import tiff

# Tags of the raw directory and of the camera profile.
TAGS = {
    "make": 271, "model": 272, "version": 50706, "backward_version": 50707, "unique_model": 50708, "cfa_repeat": 33421, "cfa_pattern": 33422, "cfa_plane_color": 50710,
    "cfa_layout": 50711, "black_level": 50714, "white_level": 50717, "color_matrix1": 50721, "color_matrix2": 50722, "as_shot_neutral": 50728, "illuminant1": 50778, "illuminant2": 50779, "active_area": 50829,
}
CFA, LINEAR = 32803, 34892
_SCHEMES = {"none": 1, "ljpeg": 7, "deflate": 8}


@dataclass
class Raw:
    """A raw image: samples (rows, columns, planes), one plane for a mosaic, and how to see them."""

    samples: np.ndarray
    bits: int
    repeat: tuple[int, int] | None = (2, 2)
    pattern: tuple[int, ...] = (0, 1, 1, 2)
    black: int = 0
    white: int | None = None
    model: str = "camera"
    color_matrix1: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    as_shot_neutral: tuple[float, ...] = (1.0, 1.0, 1.0)
    illuminant1: int = 21
    tags: dict[int, tuple[str, list]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 16:
            raise ValueError("DNG: 1 to 16 bits a sample")
        if self.repeat and (self.samples.shape[2] != 1 or len(self.pattern) != self.repeat[0] * self.repeat[1]):
            raise ValueError("DNG: a mosaic has one plane and a colour for each place of its tile")
        if self.white is None:
            self.white = (1 << self.bits) - 1

    def preview(self) -> np.ndarray:
        """Eight-bit RGB, one pixel a tile (or 2 x 2 block): floors of means, black and white scaled to 0 and 255."""
        rows, width, planes = self.samples.shape
        tall, wide = self.repeat or (2, 2)
        out = np.zeros((max(rows // tall, 1), max(width // wide, 1), 3), np.uint8)
        cut = self.samples[: out.shape[0] * tall, : out.shape[1] * wide].astype(np.int64)
        y, x = np.mgrid[: cut.shape[0], : cut.shape[1]]
        colour = np.array(self.pattern).reshape(tall, wide)[y % tall, x % wide] if self.repeat else None
        for c in range(3):
            plane = cut[..., 0] if self.repeat else cut[..., min(c, planes - 1)]
            own = (colour == c) if self.repeat else np.ones(plane.shape, bool)
            total, count = np.zeros(out.shape[:2], np.int64), np.zeros(out.shape[:2], np.int64)
            np.add.at(total, (np.minimum(y // tall, out.shape[0] - 1), np.minimum(x // wide, out.shape[1] - 1)), plane * own)
            np.add.at(count, (np.minimum(y // tall, out.shape[0] - 1), np.minimum(x // wide, out.shape[1] - 1)), own)
            mean = total // np.maximum(count, 1)
            out[..., c] = np.minimum(np.maximum(mean - self.black, 0) * 255 // max(self.white - self.black, 1), 255)
        return out


def _packed(raw: Raw, order: str) -> bytes:
    flat = raw.samples.reshape(raw.samples.shape[0], -1)
    if raw.bits in (8, 16):
        return flat.astype(f"{order}u{raw.bits // 8}").tobytes()
    return codecs.pack_rows(flat, raw.bits)


def write(raw: Raw, *, compression: str = "none", big_endian: bool = False, big: bool = False) -> bytes:
    """The file: the preview's strip, the raw strip, then directories; the preview's points at the raw one."""
    order, word = (">" if big_endian else "<"), ("Q" if big else "I")
    out = bytearray(b"MM" if big_endian else b"II")
    out += struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0)))
    link = len(out) - struct.calcsize(word)
    preview = raw.preview()
    rows, width, planes = raw.samples.shape
    if compression == "ljpeg":
        data = codecs.ljpeg_encode(raw.samples, raw.bits)
    else:
        data = _packed(raw, order)
        data = codecs.deflate(data) if compression == "deflate" else data
    places = []
    for part in (preview.tobytes(), data):
        out += b"\0" * (len(out) & 1)
        places.append(len(out))
        out += part
    rational = lambda values: [(round(v * 1_000_000), 1_000_000) for v in values]
    own: list[tuple[int, int, list]] = [
        (254, 4, [0]), (256, 4, [width]), (257, 4, [rows]), (258, 3, [raw.bits] * planes), (259, 3, [_SCHEMES[compression]]), (262, 3, [CFA if raw.repeat else LINEAR]),
        (273, 4, [places[1]]), (277, 3, [planes]), (278, 4, [rows]), (279, 4, [len(data)]), (TAGS["black_level"], 4, [raw.black]), (TAGS["white_level"], 4, [raw.white]),
    ]
    if raw.repeat:
        own += [(TAGS["cfa_repeat"], 3, list(raw.repeat)), (TAGS["cfa_pattern"], 1, list(raw.pattern)), (TAGS["cfa_plane_color"], 1, [0, 1, 2]), (TAGS["cfa_layout"], 3, [1])]
    tiff.write_directory(out, own, order, big, link)  # the raw directory goes in first, so that its place is known
    at_raw = struct.unpack_from(order + word, out, link)[0]
    text = lambda s: [s.encode() + b"\0"]
    first: list[tuple[int, int, list]] = [
        (254, 4, [1]), (256, 4, [preview.shape[1]]), (257, 4, [preview.shape[0]]), (258, 3, [8, 8, 8]), (259, 3, [1]), (262, 3, [2]), (273, 4, [places[0]]), (277, 3, [3]), (278, 4, [preview.shape[0]]), (279, 4, [preview.size]),
        (330, 18 if big else 4, [at_raw]), (TAGS["version"], 1, [1, 4, 0, 0]), (TAGS["backward_version"], 1, [1, 4, 0, 0]), (TAGS["unique_model"], 2, text(raw.model)), (TAGS["color_matrix1"], 10, rational(raw.color_matrix1)),
        (TAGS["as_shot_neutral"], 5, rational(raw.as_shot_neutral)), (TAGS["illuminant1"], 3, [raw.illuminant1]),
    ]
    tiff.write_directory(out, first, order, big, link)
    return bytes(out)


def read(data: bytes) -> Raw:
    """The raw image and its profile; ``ValueError`` where there is none or it is damaged."""
    reader = tiff.Reader(data)
    trees = list(reader.directories())
    found = next((tags for _, tags in trees if tags.get(262, ("", [0]))[1][:1] in ([CFA], [LINEAR])), None)
    if found is None:
        raise ValueError("DNG: no raw image")
    try:
        one = lambda tag, default=None: found[tag][1][0] if tag in found else default
        width, rows, bits, planes, scheme = one(256), one(257), one(258), one(277, 1), one(259, 1)
        if rows * width * planes * 2 > tiff.MOST_IMAGE:
            raise ValueError("DNG: too large")
        part = b"".join(data[a : a + n] for a, n in zip(found[273][1], found[279][1], strict=True))
        if scheme == 7:
            samples = codecs.ljpeg_decode(part)
        else:
            part = codecs.inflate(part) if scheme == 8 else part
            if bits in (8, 16):
                samples = np.frombuffer(part, f"{reader.order}u{bits // 8}", rows * width * planes)
            else:
                samples = codecs.unpack_rows(part, rows, width * planes, bits)
        samples = samples.reshape(rows, width, planes).astype(np.uint16)
        real = lambda tag, default: tuple(a / b for a, b in next((t[tag][1] for _, t in trees if tag in t), [])) or default
        model = next((t[TAGS["unique_model"]][1][0].rstrip(b"\0").decode() for _, t in trees if TAGS["unique_model"] in t), "")
        light = next((t[TAGS["illuminant1"]][1][0] for _, t in trees if TAGS["illuminant1"] in t), 0)
        repeat = tuple(found[TAGS["cfa_repeat"]][1]) if TAGS["cfa_repeat"] in found else None
        pattern = tuple(found[TAGS["cfa_pattern"]][1]) if repeat else ()
        return Raw(samples, bits, repeat, pattern, one(TAGS["black_level"], 0), one(TAGS["white_level"]), model, real(TAGS["color_matrix1"], ()), real(TAGS["as_shot_neutral"], ()), light, found)
    except (KeyError, IndexError, TypeError, ZeroDivisionError) as e:
        raise ValueError("DNG: a tag is missing or malformed") from e


_SCHEMA = "path string, width int, rows int, planes int, bits int, black long, white long, model string, samples binary, error string"


def read_raws(files: DataFrame, *, mode: str = "permissive") -> DataFrame:
    """``files`` (path, content) to one row a raw image, its samples as little-endian 16-bit integers."""

    def found(raw: bytes | None) -> tuple:
        try:
            x = read(raw or b"")
            return x.samples.shape[1], x.samples.shape[0], x.samples.shape[2], x.bits, x.black, x.white, x.model, x.samples.astype("<u2").tobytes(), None
        except ValueError as e:
            if mode == "failfast":
                raise
            return *[None] * 8, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        known = Once(found)
        rows = ((path.as_py(), *known(raw.as_py())) for batch in batches for path, raw in zip(*batch.columns, strict=True))
        yield from batched(rows, names, types, 8)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)
