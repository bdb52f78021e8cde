"""Arithmetic coders of block codecs: the boolean coder of VP8 and the multi-symbol range coder of AV1.

Both are written on exact integers: the low end of the interval is one number that grows with every shift, so carries
need no care, and the stream is that number. Probabilities and cumulative frequencies may adapt between symbols.
"""

from __future__ import annotations

from collections.abc import Sequence


class BoolWriter:
    """VP8's boolean coder: ``prob`` of 256 that a flag is false."""

    def __init__(self) -> None:
        self._low, self._range, self._bits = 0, 255, 8

    def put(self, flag: bool, prob: int = 128) -> None:
        split = 1 + ((self._range - 1) * prob >> 8)
        if flag:
            self._low += split
            self._range -= split
        else:
            self._range = split
        shift = max(0, 8 - self._range.bit_length())
        self._low <<= shift
        self._range <<= shift
        self._bits += shift

    def literal(self, value: int, size: int) -> None:
        for k in range(size - 1, -1, -1):
            self.put(bool(value >> k & 1))

    def tree(self, path: Sequence[tuple[int, bool]], probs: Sequence[int]) -> None:
        """A leaf by its path: (place of the probability, branch) from the root."""
        for place, branch in path:
            self.put(branch, probs[place])

    def finish(self) -> bytes:
        pad = -self._bits % 8
        return (self._low << pad).to_bytes((self._bits + pad) // 8, "big") + b"\0\0"


class BoolReader:
    def __init__(self, raw: bytes) -> None:
        self._raw, self._at, self._range = raw, 1, 255
        self._value, self._left = (raw[0] if raw else 0), 0

    def get(self, prob: int = 128) -> bool:
        split = 1 + ((self._range - 1) * prob >> 8)
        flag = self._value >> self._left >= split
        if flag:
            self._range -= split
            self._value -= split << self._left
        else:
            self._range = split
        while self._range < 128:
            self._range <<= 1
            if not self._left:
                self._value = self._value << 8 | (self._raw[self._at] if self._at < len(self._raw) else 0)
                self._at += 1
                self._left = 8
            self._left -= 1
        return flag

    def literal(self, size: int) -> int:
        value = 0
        for _ in range(size):
            value = value << 1 | self.get()
        return value

    @property
    def past_end(self) -> bool:
        return self._at > len(self._raw)


def tree_paths(tree: Sequence[int]) -> dict[int, list[tuple[int, bool]]]:
    """Paths to the leaves of a tree in VP8's form: pairs of branches, a positive number is the next pair's place, any
    other the negated leaf."""
    out: dict[int, list[tuple[int, bool]]] = {}

    def walk(at: int, path: list[tuple[int, bool]]) -> None:
        for branch in (0, 1):
            step = [*path, (at >> 1, bool(branch))]
            if tree[at + branch] > 0:
                walk(tree[at + branch], step)
            else:
                out[-tree[at + branch]] = step

    walk(0, [])
    return out


# --- AV1 --------------------------------------------------------------------------------------------------------------


def _floor(range_: int, cdf: Sequence[int], symbol: int) -> int:
    """The low end of a symbol's part of the interval, counted from the last symbol; every symbol keeps a floor of 4."""
    if symbol < 0:
        return range_
    return ((range_ >> 8) * ((32768 - cdf[symbol]) >> 6) >> 1) + 4 * (len(cdf) - symbol - 1)


def adapt(cdf: list[int], symbol: int, count: int) -> int:
    """Moves cumulative frequencies (of 32768, the last one included) toward a symbol; returns the next count."""
    rate = 3 + (count > 15) + (count > 31) + min(len(cdf).bit_length() - 1, 2)
    cdf[:symbol] = [x - (x >> rate) for x in cdf[:symbol]]
    cdf[symbol:-1] = [x + ((32768 - x) >> rate) for x in cdf[symbol:-1]]
    return min(count + 1, 32)


class SymbolWriter:
    def __init__(self) -> None:
        self._low, self._range, self._bits = 0, 1 << 15, 15

    def put(self, symbol: int, cdf: Sequence[int]) -> None:
        top, floor = _floor(self._range, cdf, symbol - 1), _floor(self._range, cdf, symbol)
        self._low += floor
        self._range = top - floor
        shift = 16 - self._range.bit_length()
        self._low <<= shift
        self._range <<= shift
        self._bits += shift

    def literal(self, value: int, size: int) -> None:
        for k in range(size - 1, -1, -1):
            self.put(value >> k & 1, (1 << 14, 1 << 15))

    def finish(self) -> bytes:
        """The stream is the complement; zeros behind it read as the upper end of the last interval."""
        pad = -self._bits % 8
        return ((((1 << self._bits) - 1) ^ self._low) << pad).to_bytes((self._bits + pad) // 8, "big")


class SymbolReader:
    def __init__(self, raw: bytes) -> None:
        self._text, self._size, self._at = int.from_bytes(raw, "big"), 8 * len(raw), 0
        self._range = 1 << 15
        self._value = ((1 << 15) - 1) ^ self._next(15)

    def _next(self, size: int) -> int:
        """Bits of the stream, zeros behind its end."""
        self._at += size
        over = max(0, self._at - self._size)
        have = size - min(size, over)
        return (self._text >> max(0, self._size - self._at) & ((1 << have) - 1)) << (size - have) if have else 0

    def get(self, cdf: Sequence[int]) -> int:
        part, value, top, symbol, spare = self._range >> 8, self._value, self._range, 0, 4 * len(cdf) - 4
        for x in cdf:  # the parts' low ends in turn, as in _floor
            floor = (part * (32768 - x >> 6) >> 1) + spare
            if floor <= value:
                break
            symbol, top, spare = symbol + 1, floor, spare - 4
        self._range, self._value = top - floor, self._value - floor
        shift = 16 - self._range.bit_length()
        self._range <<= shift
        self._value = (self._value << shift) + ((1 << shift) - 1 ^ self._next(shift))
        return symbol

    def literal(self, size: int) -> int:
        value = 0
        for _ in range(size):
            value = value << 1 | self.get((1 << 14, 1 << 15))
        return value


def _flat(symbols: int) -> list[int]:
    return [32768 * (k + 1) // symbols for k in range(symbols)]


def encode_bytes(raw: bytes) -> bytes:
    """Bytes as two adaptive symbols of four bits each, the second in the context of the first."""
    writer, high, low, counts = SymbolWriter(), _flat(16), [_flat(16) for _ in range(16)], [0] * 17
    for byte in raw:
        a, b = byte >> 4, byte & 15
        writer.put(a, high)
        counts[16] = adapt(high, a, counts[16])
        writer.put(b, low[a])
        counts[a] = adapt(low[a], b, counts[a])
    return writer.finish()


def decode_bytes(raw: bytes, size: int) -> bytes:
    reader, high, low, counts, out = SymbolReader(raw), _flat(16), [_flat(16) for _ in range(16)], [0] * 17, bytearray()
    for _ in range(size):
        a = reader.get(high)
        counts[16] = adapt(high, a, counts[16])
        b = reader.get(low[a])
        counts[a] = adapt(low[a], b, counts[a])
        out.append(a << 4 | b)
    return bytes(out)
