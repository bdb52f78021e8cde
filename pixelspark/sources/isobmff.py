"""ISOBMFF: boxes of an AVIF still image around coded data, and a walk over boxes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

_NESTED = {b"meta": 4, b"iprp": 0, b"ipco": 0, b"iinf": 6}


def box(kind: bytes, *parts: bytes, version: int | None = None) -> bytes:
    body = (b"" if version is None else bytes([version, 0, 0, 0])) + b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def avif_still(data: bytes, width: int, height: int, *, channels: int = 3, depth: int = 8, av1c: bytes = b"\x81\x00\x00\x00", nclx: tuple[int, int, int, bool] = (1, 13, 0, True), rotation: int = 0, mirror: int | None = None) -> bytes:
    """The file: brands, item tables and properties (rotation counter-clockwise in quarter turns), then the data.
    Boxes are built from the inside out, so every length is known; only the data's place is found afterwards."""
    u16, u32 = (lambda *v: struct.pack(f">{len(v)}H", *v)), (lambda *v: struct.pack(f">{len(v)}I", *v))
    properties = [box(b"av1C", av1c), box(b"ispe", u32(width, height), version=0), box(b"pixi", bytes([channels, *[depth] * channels]), version=0), box(b"colr", b"nclx", u16(*nclx[:3]), bytes([nclx[3] << 7]))]
    needed = [True, False, False, False]
    if rotation % 4:
        properties.append(box(b"irot", bytes([rotation % 4])))
        needed.append(True)
    if mirror is not None:
        properties.append(box(b"imir", bytes([mirror & 1])))
        needed.append(True)
    uses = bytes([k + 1 | (128 if x else 0) for k, x in enumerate(needed)])
    head = box(b"ftyp", b"avif", u32(0), b"avifmif1miafMA1A")

    def meta(place: int) -> bytes:
        return box(
            b"meta",
            box(b"hdlr", u32(0), b"pict", u32(0, 0, 0), b"\0", version=0),
            box(b"pitm", u16(1), version=0),
            box(b"iloc", b"\x44\x00", u16(1, 1, 0, 1), u32(place, len(data)), version=0),
            box(b"iinf", u16(1), box(b"infe", u16(1, 0), b"av01\0", version=2), version=0),
            box(b"iprp", box(b"ipco", *properties), box(b"ipma", u32(1), u16(1), bytes([len(uses)]), uses, version=0)),
            version=0,
        )

    place = len(head) + len(meta(0)) + 8
    return head + meta(place) + box(b"mdat", data)


def boxes(raw: bytes, prefix: str = "") -> Iterator[tuple[str, int, bytes]]:
    """(path, size, payload) of every box, those inside after their parent."""
    at = 0
    while at < len(raw):
        if at + 8 > len(raw):
            raise ValueError("ISOBMFF: truncated box")
        size, kind = struct.unpack_from(">I4s", raw, at)
        if size < 8 or at + size > len(raw):
            raise ValueError("ISOBMFF: bad box size")
        path, payload = f"{prefix}/{kind.decode('latin-1')}", raw[at + 8 : at + size]
        yield path, size, payload
        if kind in _NESTED:
            yield from boxes(payload[_NESTED[kind] :], path)
        at += size
