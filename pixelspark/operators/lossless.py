"""Lossless WebP streams (RFC 9649): an encoder that picks a palette or spatial transforms, and a full decoder.

Images are (rows, columns, 4) arrays in the order alpha, red, green, blue. Bits are strings in stream order, lowest bit
of each byte first, so a prefix code is a key of a dictionary. Forward transforms are array operations; the inverse of
the spatial predictor is a recurrence over pixels, so one image is one task and many images are many.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

from ..sources import riff
from .codecs import canonical_codes, huffman_lengths
from .video import CACHE_MULTIPLIER, neighbourhood

SIGNATURE = 0x2F
PREDICTOR, COLOUR, GREEN, INDEX = range(4)
MOST_COPY, LEAST_COPY = 4096, 3
MOST_LENGTH = 15
# The order in which lengths of code-length codes are written.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_SIZES = (256 + 24, 256, 256, 256, 40)  # green with lengths, red, blue, alpha, distances
BLACK = np.array([255, 0, 0, 0], np.int64)


# --- bits -----------------------------------------------------------------------------------------------------------


def _field(value: int, size: int) -> str:
    return format(value, f"0{size}b")[::-1] if size else ""


def _bytes(bits: str) -> bytes:
    bits += "0" * (-len(bits) % 8)
    return int(bits[::-1] or "0", 2).to_bytes(len(bits) // 8, "little")


class _Bits:
    def __init__(self, raw: bytes) -> None:
        self.text = format(int.from_bytes(raw, "little"), f"0{8 * len(raw)}b")[::-1] if raw else ""
        self.at = 0

    def take(self, size: int) -> int:
        part = self.text[self.at : self.at + size]
        if len(part) != size:
            raise ValueError("lossless WebP: truncated")
        self.at += size
        return int(part[::-1], 2) if size else 0

    def symbol(self, code: dict[str, int]) -> int:
        if "" in code:
            return code[""]
        for size in range(1, MOST_LENGTH + 1):
            found = code.get(self.text[self.at : self.at + size])
            if found is not None:
                if self.at + size > len(self.text):
                    break
                self.at += size
                return found
        raise ValueError("lossless WebP: invalid code")


# --- prefix codes -----------------------------------------------------------------------------------------------------


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, extra) of a length or distance from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, high - 1, v - ((2 + second) << (high - 1))


def _codes_of(lengths: dict[int, int]) -> dict[int, str]:
    """Codes as they stand in the stream; the only symbol of a code costs nothing."""
    return dict.fromkeys(lengths, "") if len(lengths) == 1 else canonical_codes(lengths)


def _write_code(counts: Counter, size: int) -> tuple[str, dict[int, str]]:
    """A code's description and its codes, for the symbols that occur."""
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        wide = symbols[0] > 1
        text = "1" + _field(len(symbols) - 1, 1) + _field(wide, 1) + _field(symbols[0], 8 if wide else 1) + "".join(_field(x, 8) for x in symbols[1:])
        return text, {symbols[0]: ""} if len(symbols) == 1 else {symbols[0]: "0", symbols[1]: "1"}
    if len(symbols) == 1:
        symbols = sorted({symbols[0], 0 if symbols[0] else 1})
        counts = Counter(counts) | Counter(dict.fromkeys(symbols, 1))
    lengths = huffman_lengths(counts, MOST_LENGTH)
    # Lengths in turn, with runs of zeros as 17 and 18.
    tokens: list[tuple[int, str]] = []
    k = 0
    while k < size:
        if lengths.get(k, 0):
            tokens.append((lengths[k], ""))
            k += 1
            continue
        run = 1
        while k + run < size and not lengths.get(k + run, 0) and run < 138:
            run += 1
        if run >= 11:
            tokens.append((18, _field(run - 11, 7)))
        elif run >= 3:
            tokens.append((17, _field(run - 3, 3)))
        else:
            tokens += [(0, "")] * run
        k += run
    own = huffman_lengths(Counter(t for t, _ in tokens), 7)
    codes = _codes_of(own)
    last = max(i for i, x in enumerate(_LENGTH_ORDER) if own.get(x, 0)) + 1
    last = max(last, 4)
    text = "0" + _field(last - 4, 4) + "".join(_field(own.get(x, 0), 3) for x in _LENGTH_ORDER[:last]) + "0"
    return text + "".join(codes[t] + extra for t, extra in tokens), _codes_of(lengths)


def _checked(lengths: dict[int, int]) -> dict[str, int]:
    if not lengths:
        raise ValueError("lossless WebP: an empty code")
    if len(lengths) > 1 and sum(1 << (MOST_LENGTH - n) for n in lengths.values()) != 1 << MOST_LENGTH:
        raise ValueError("lossless WebP: an incomplete code")
    return {code: symbol for symbol, code in _codes_of(lengths).items()}


def _read_code(bits: _Bits, size: int) -> dict[str, int]:
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1), *([bits.take(8)] if two else [])]
        if max(symbols) >= size:
            raise ValueError("lossless WebP: a symbol outside its alphabet")
        return {"": symbols[0]} if len(set(symbols)) == 1 else {"0": min(symbols), "1": max(symbols)}
    own = {x: n for x in _LENGTH_ORDER[: bits.take(4) + 4] if (n := bits.take(3))}
    code = _checked(own)
    most = size
    if bits.take(1):
        most = 2 + bits.take(2 + 2 * bits.take(3))
    lengths: dict[int, int] = {}
    k, last = 0, 8
    while k < size and most:
        most -= 1
        t = bits.symbol(code)
        if t < 16:
            if t:
                lengths[k] = last = t
            k += 1
            continue
        run, value = {16: (lambda: 3 + bits.take(2), last), 17: (lambda: 3 + bits.take(3), 0), 18: (lambda: 11 + bits.take(7), 0)}[t]
        n = run()
        if k + n > size:
            raise ValueError("lossless WebP: too many code lengths")
        if value:
            lengths |= dict.fromkeys(range(k, k + n), value)
        k += n
    return _checked(lengths)


# --- entropy-coded images -----------------------------------------------------------------------------------------


def _tokens(colours: list[int]) -> Iterator[tuple[int, int]]:
    """(length, distance) of copies and (0, colour) of literals, greedily from the last place of each three colours."""
    last: dict[tuple[int, ...], int] = {}
    at, n = 0, len(colours)
    while at < n:
        key = tuple(colours[at : at + LEAST_COPY])
        before, size = last.get(key), 0
        if before is not None and len(key) == LEAST_COPY:
            while size < MOST_COPY and at + size < n and colours[before + size] == colours[at + size]:
                size += 1
        if size >= LEAST_COPY:
            yield size, at - before
        else:
            size = 1
            yield 0, colours[at]
        for k in range(at, min(at + size, n - LEAST_COPY + 1)):
            last[tuple(colours[k : k + LEAST_COPY])] = k
        at += size


def _distance_codes(width: int) -> dict[int, int]:
    codes: dict[int, int] = {}
    for k, (x, y) in enumerate(neighbourhood()):
        codes.setdefault(max(1, x + y * width), k + 1)
    return codes


def _write_pixels(image: np.ndarray, main: bool) -> str:
    """An entropy-coded image with one group of codes and no colour cache."""
    rows, width, _ = image.shape
    colours = ((image[..., 0] << 24) | (image[..., 1] << 16) | (image[..., 2] << 8) | image[..., 3]).reshape(-1).tolist()
    near, counts, found = _distance_codes(width), [Counter() for _ in _SIZES], []
    for size, value in _tokens(colours):
        if size:
            a, b = _prefix(size), _prefix(near.get(value, value + len(neighbourhood())))
            counts[0][256 + a[0]] += 1
            counts[4][b[0]] += 1
            found.append((a, b))
        else:
            parts = (value >> 8 & 255, value >> 16 & 255, value & 255, value >> 24)
            for k, x in enumerate(parts):
                counts[k][x] += 1
            found.append(parts)
    texts, codes = zip(*[_write_code(c, n) for c, n in zip(counts, _SIZES, strict=True)], strict=True)
    out = ["0", "0" if main else "", *texts]
    for x in found:
        if len(x) == 2:
            (p, n, e), (q, m, f) = x
            out.append(codes[0][256 + p] + _field(e, n) + codes[4][q] + _field(f, m))
        else:
            out.append("".join(codes[k][v] for k, v in enumerate(x)))
    return "".join(out)


def _read_pixels(bits: _Bits, rows: int, width: int, main: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("lossless WebP: bad colour cache")
    cache = [0] * (1 << cache_bits)
    group_bits, groups = 0, None
    if main and bits.take(1):
        group_bits = bits.take(3) + 2
        across = -(-width // (1 << group_bits))
        picture = _read_pixels(bits, -(-rows // (1 << group_bits)), across, False)
        groups = ((picture[..., 1] << 8) | picture[..., 2]).tolist()
    n_groups = 1 + max(map(max, groups)) if groups else 1
    extra = (1 << cache_bits) if cache_bits else 0
    all_codes = [[_read_code(bits, n + (extra if k == 0 else 0)) for k, n in enumerate(_SIZES)] for _ in range(n_groups)]
    near, out, total = neighbourhood(), [], rows * width

    def value(prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        n = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << n) + bits.take(n) + 1

    def keep(colour: int) -> None:
        out.append(colour)
        if cache_bits:
            cache[(CACHE_MULTIPLIER * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour

    while len(out) < total:
        y, x = divmod(len(out), width)
        codes = all_codes[groups[y >> group_bits][x >> group_bits] if groups else 0]
        s = bits.symbol(codes[0])
        if s < 256:
            red, blue, alpha = (bits.symbol(codes[k]) for k in (1, 2, 3))
            keep(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            size = value(s - 256)
            code = value(bits.symbol(codes[4]))
            if code > len(near):
                back = code - len(near)
            else:
                dx, dy = near[code - 1]
                back = max(1, dx + dy * width)
            if back > len(out) or len(out) + size > total:
                raise ValueError("lossless WebP: a copy outside the image")
            for _ in range(size):
                keep(out[-back])
        else:
            keep(cache[s - 280])
    flat = np.array(out, np.int64).reshape(rows, width)
    return np.stack([flat >> 24, flat >> 16 & 255, flat >> 8 & 255, flat & 255], axis=2)


# --- transforms -------------------------------------------------------------------------------------------------------


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) // 2


def _nearer(l: np.ndarray, t: np.ndarray, tl: np.ndarray) -> np.ndarray:
    guess = l + t - tl
    left = np.abs(guess - l).sum(axis=-1) < np.abs(guess - t).sum(axis=-1)
    return np.where(left[..., None], l, t)


def _beyond(l: np.ndarray, t: np.ndarray, tl: np.ndarray) -> np.ndarray:
    mid = _half(l, t)
    return np.clip(mid + np.trunc((mid - tl) / 2).astype(np.int64), 0, 255)


_MODES: list[Callable[..., np.ndarray]] = [
    lambda l, t, tl, tr: np.broadcast_to(BLACK, l.shape), lambda l, t, tl, tr: l, lambda l, t, tl, tr: t, lambda l, t, tl, tr: tr, lambda l, t, tl, tr: tl,
    lambda l, t, tl, tr: _half(_half(l, tr), t), lambda l, t, tl, tr: _half(l, tl), lambda l, t, tl, tr: _half(l, t), lambda l, t, tl, tr: _half(tl, t), lambda l, t, tl, tr: _half(t, tr),
    lambda l, t, tl, tr: _half(_half(l, tl), _half(t, tr)), lambda l, t, tl, tr: _nearer(l, t, tl), lambda l, t, tl, tr: np.clip(l + t - tl, 0, 255), lambda l, t, tl, tr: _beyond(l, t, tl),
]


def predict_forward(image: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals, and the picture of each block's cheapest mode."""
    rows, width, _ = image.shape
    l, t, tl, tr = (np.zeros_like(image) for _ in range(4))
    l[:, 1:], t[1:], tl[1:, 1:] = image[:, :-1], image[:-1], image[:-1, :-1]
    tr[1:, :-1], tr[1:, -1] = image[:-1, 1:], image[1:, 0]
    rests, costs = [], []
    size = 1 << bits
    for mode in _MODES:
        guess = np.array(mode(l, t, tl, tr))
        guess[0, 1:], guess[1:, 0], guess[0, 0] = image[0, :-1], image[:-1, 0], BLACK
        rest = (image - guess) % 256
        cost = np.minimum(rest, 256 - rest).sum(axis=2)
        rests.append(rest)
        costs.append(np.add.reduceat(np.add.reduceat(cost, np.arange(0, rows, size), axis=0), np.arange(0, width, size), axis=1))
    best = np.argmin(costs, axis=0)
    picked = np.array(rests)[best.repeat(size, 0).repeat(size, 1)[:rows, :width], np.arange(rows)[:, None], np.arange(width)]
    picture = np.zeros((*best.shape, 4), np.int64)
    picture[..., 0], picture[..., 2] = 255, best
    return picked, picture


def predict_inverse(rest: np.ndarray, picture: np.ndarray, bits: int) -> np.ndarray:
    rows, width, _ = rest.shape
    out = rest.copy()
    modes = picture[..., 2]
    for y in range(rows):
        for x in range(width):
            if not y:
                guess = out[0, x - 1] if x else BLACK
            elif not x:
                guess = out[y - 1, 0]
            else:
                mode = int(modes[y >> bits, x >> bits])
                above = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _MODES[mode if mode < len(_MODES) else 0](out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], above)
            out[y, x] = (out[y, x] + guess) & 255
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128) % 256 - 128


def colour_inverse(image: np.ndarray, picture: np.ndarray, bits: int) -> np.ndarray:
    rows, width, _ = image.shape
    own = _signed(picture.repeat(1 << bits, 0).repeat(1 << bits, 1)[:rows, :width])
    out, green = image.copy(), _signed(image[..., 2])
    out[..., 1] = (image[..., 1] + (own[..., 3] * green >> 5)) & 255
    out[..., 3] = (image[..., 3] + (own[..., 2] * green >> 5) + (own[..., 1] * _signed(out[..., 1]) >> 5)) & 255
    return out


def colour_forward(image: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each block's least-squares coefficients in 32nds, and what they leave of red and blue."""
    rows, width, _ = image.shape
    size = 1 << bits
    r, g, b = (_signed(image[..., k]) for k in (1, 2, 3))
    total = lambda x: np.add.reduceat(np.add.reduceat(x, np.arange(0, rows, size), axis=0), np.arange(0, width, size), axis=1)

    def ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
        return np.where(den == 0, 0, np.clip(np.trunc(num * 32 / np.maximum(den, 1)), -128, 127)).astype(np.int64)

    gg = total(g * g)
    picture = np.stack([np.full(gg.shape, 255), ratio(total(b * r), total(r * r)) & 255, ratio(total(b * g), gg) & 255, ratio(total(r * g), gg) & 255], axis=2)
    own = _signed(picture.repeat(size, 0).repeat(size, 1)[:rows, :width])
    out = image.copy()
    out[..., 1] = (image[..., 1] - (own[..., 3] * g >> 5)) & 255
    out[..., 3] = (image[..., 3] - (own[..., 2] * g >> 5) - (own[..., 1] * r >> 5)) & 255
    return out, picture


def green_forward(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1], out[..., 3] = (image[..., 1] - image[..., 2]) & 255, (image[..., 3] - image[..., 2]) & 255
    return out


def green_inverse(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1], out[..., 3] = (image[..., 1] + image[..., 2]) & 255, (image[..., 3] + image[..., 2]) & 255
    return out


def _index_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# --- streams ----------------------------------------------------------------------------------------------------------


def encode(image: np.ndarray, block_bits: int = 4, colour: bool = False) -> bytes:
    """A stream: a palette of up to 256 colours in the order of their first pixels, or the spatial transforms."""
    image = image.astype(np.int64)
    rows, width, _ = image.shape
    if not 1 <= rows <= 1 << 14 or not 1 <= width <= 1 << 14:
        raise ValueError("lossless WebP: sides are 1 to 16384")
    out = [_field(SIGNATURE, 8), _field(width - 1, 14), _field(rows - 1, 14), _field(int((image[..., 0] != 255).any()), 1), _field(0, 3)]
    colours, first, of = np.unique(image.reshape(-1, 4), axis=0, return_index=True, return_inverse=True)
    if len(colours) <= 256:
        order = np.argsort(first)
        table, place = colours[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shrink = _index_bits(len(table))
        per, each = 1 << shrink, 8 >> shrink
        indices = np.zeros((rows, -(-width // per) * per), np.int64)
        indices[:, :width] = place[of.reshape(rows, width)]
        packed = (indices.reshape(rows, -1, per) << (each * np.arange(per))).sum(axis=2)
        main = np.zeros((*packed.shape, 4), np.int64)
        main[..., 0], main[..., 2] = 255, packed
        steps = np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int64)) % 256
        out += ["1", _field(INDEX, 2), _field(len(table) - 1, 8), _write_pixels(steps[None], False)]
    else:
        out += ["1", _field(GREEN, 2)]
        main, picture = predict_forward(green_forward(image), block_bits)
        out += ["1", _field(PREDICTOR, 2), _field(block_bits - 2, 3), _write_pixels(picture, False)]
        if colour:
            main, picture = colour_forward(main, block_bits)
            out += ["1", _field(COLOUR, 2), _field(block_bits - 2, 3), _write_pixels(picture, False)]
    return _bytes("".join([*out, "0", _write_pixels(main, True)]))


def decode(raw: bytes) -> np.ndarray:
    """The image of a stream; its transforms are undone from the last to the first."""
    bits = _Bits(raw)
    if bits.take(8) != SIGNATURE:
        raise ValueError("lossless WebP: bad signature")
    width, rows = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("lossless WebP: unknown version")
    if width * rows > 8 * len(raw) * MOST_COPY:
        raise ValueError("lossless WebP: larger than its stream can be")
    undo: list[Callable[[np.ndarray], np.ndarray]] = []
    seen, now = set(), width
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("lossless WebP: a transform comes twice")
        seen.add(kind)
        if kind == GREEN:
            undo.append(green_inverse)
        elif kind == INDEX:
            n = bits.take(8) + 1
            table = np.cumsum(_read_pixels(bits, 1, n, False)[0], axis=0) % 256
            table = np.vstack([table, np.zeros((256 - n, 4), np.int64)])
            shrink, whole = _index_bits(n), now
            now = -(-whole // (1 << shrink))

            def indexed(x: np.ndarray, table: np.ndarray = table, shrink: int = shrink, whole: int = whole) -> np.ndarray:
                per, each = 1 << shrink, 8 >> shrink
                parts = (x[..., 2][:, :, None] >> (each * np.arange(per))) & ((1 << each) - 1)
                return table[parts.reshape(len(x), -1)[:, :whole]]

            undo.append(indexed)
        else:
            size = bits.take(3) + 2
            picture = _read_pixels(bits, -(-rows // (1 << size)), -(-now // (1 << size)), False)
            work = predict_inverse if kind == PREDICTOR else colour_inverse
            undo.append(lambda x, work=work, picture=picture, size=size: work(x, picture, size))
    image = _read_pixels(bits, rows, now, True)
    for work in reversed(undo):
        image = work(image)
    return image


def write_webp(image: np.ndarray, **options: object) -> bytes:
    return riff.assemble([("VP8L", encode(image, **options))])


def read_webp(raw: bytes) -> np.ndarray:
    for _, code, _, payload in riff.chunks(raw):
        if code == "VP8L":
            return decode(payload)
    raise ValueError("WebP: no lossless stream")


# --- alpha planes beside lossy images ---------------------------------------------------------------------------------


def _alpha_guess(plane: np.ndarray, kind: int) -> np.ndarray:
    """Predictions of the four filters (none, left, above, gradient) from the plane itself."""
    left, up, corner = (np.zeros_like(plane) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = plane[:, :-1], plane[:-1], plane[:-1, :-1]
    if kind == 0:
        return np.zeros_like(plane)
    guess = {1: left, 2: up, 3: np.clip(left + up - corner, 0, 255)}[kind].copy()
    guess[1:, 0] = up[1:, 0] if kind != 2 else guess[1:, 0]
    guess[0, 1:] = left[0, 1:]
    guess[0, 0] = 0
    return guess


def write_alpha(plane: np.ndarray) -> bytes:
    """An ALPH payload: the filter of least residual, or a lossless stream where that is shorter."""
    plane = plane.astype(np.int64)
    rests = [(plane - _alpha_guess(plane, k)) % 256 for k in range(4)]
    kind = int(np.argmin([np.minimum(x, 256 - x).sum() for x in rests]))
    plain = bytes([kind << 2]) + rests[kind].astype(np.uint8).tobytes()
    image = np.zeros((*plane.shape, 4), np.int64)
    image[..., 0], image[..., 2] = 255, plane
    packed = b"\x01" + encode(image)[5:]  # without signature and sides, which are 40 bits
    return packed if len(packed) < len(plain) else plain


def read_alpha(payload: bytes, rows: int, width: int) -> np.ndarray:
    if not payload:
        raise ValueError("ALPH: empty")
    kind, how = payload[0] >> 2 & 3, payload[0] & 3
    if how == 0:
        if len(payload) != 1 + rows * width:
            raise ValueError("ALPH: wrong size")
        rest = np.frombuffer(payload, np.uint8, offset=1).reshape(rows, width).astype(np.int64)
    elif how == 1:
        head = _bytes(_field(SIGNATURE, 8) + _field(width - 1, 14) + _field(rows - 1, 14) + _field(0, 4))
        rest = decode(head + payload[1:])[..., 2]
    else:
        raise ValueError("ALPH: reserved method")
    if not kind:
        return rest.astype(np.uint8)
    out = rest.copy()
    for y in range(rows):
        for x in range(width):
            left, up = (int(out[y, x - 1]) if x else None), (int(out[y - 1, x]) if y else None)
            if left is None and up is None:
                continue
            if left is None or up is None:
                guess = up if left is None else left
            else:
                guess = left if kind == 1 else up if kind == 2 else min(max(left + up - int(out[y - 1, x - 1]), 0), 255)
            out[y, x] = (out[y, x] + guess) & 255
    return out.astype(np.uint8)
