"""Integer signal maths as Column expressions: rounding, companding, transforms, codes and wrap-around.

Values are BIGINT inside, since ANSI mode raises on overflow; results that wrap are brought back by ``wrap8`` and the
like.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column) -> Column:
    return x.cast("long")


def wrap8(x: Column) -> Column:
    return F.pmod(x, F.lit(256))


def signed8(x: Column) -> Column:
    return F.pmod(x + 128, F.lit(256)) - 128


def signed16(x: Column) -> Column:
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def round2(x: Column, n: int) -> Column:
    """Shift right by ``n`` with rounding; the value itself for 0."""
    return _long(x) if n == 0 else F.shiftright(_long(x) + (1 << (n - 1)), n)


def round2_signed(x: Column, n: int) -> Column:
    return F.when(x >= 0, round2(x, n)).otherwise(-round2(-_long(x), n))


def clip3(low: Column | int, high: Column | int, x: Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(F.least(x, as_column(high)), as_column(low))


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", _long(a), _long(b if isinstance(b, Column) else F.lit(b)))


def round_div_nearest(num: Column, den: Column) -> Column:
    half = div(den, 2)
    return F.when(num >= 0, div(num + half, den)).otherwise(-div(-num + half, den))


def div_round_up(num: Column, den: Column | int) -> Column:
    return div(num + den - 1, den)


def mu_compress(value: Column, mu: float) -> Column:
    v = F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))
    return F.signum(v) * F.log(F.abs(v) * mu + 1.0) / math.log(1.0 + mu)


def mu_expand(code: Column, mu: float) -> Column:
    return F.signum(code) * (F.pow(F.lit(1.0 + mu), F.abs(code)) - 1.0) / mu


def _top_index(bits: int) -> int:
    if not 2 <= bits <= 31:
        raise ValueError("bits must be from 2 to 31")
    return (1 << bits) - 2


def round_half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def mu_quantize(value: Column, bits: int, mu: float) -> Column:
    top = _top_index(bits)
    return clip3(0, top, round_half_away((mu_compress(value, mu) + 1.0) / 2.0 * float(top)))


def mu_dequantize(index: Column, bits: int, mu: float) -> Column:
    top = _top_index(bits)
    return mu_expand(F.least(index, F.lit(top)) / float(top) * 2.0 - 1.0, mu)


# Lossless 4 x 4 Walsh-Hadamard: the lifting steps of four values, forward and back.


def _lift(v: Sequence[Column]) -> list[Column]:
    first, last = v[0] + v[1], v[3] - v[2]
    mid = F.shiftright(first - last, 1)
    one, three = mid - v[2], mid - v[1]
    return [first - one, one, last + three, three]


def _unlift(v: Sequence[Column]) -> list[Column]:
    a, c, d, b = v
    a, d = a + c, d - b
    mid = F.shiftright(a - d, 1)
    b, c = mid - b, mid - c
    return [a - b, b, c, d + c]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: chained expressions would otherwise repeat it at every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cells(block: Column) -> list[list[Column]]:
    return [[_long(F.element_at(block, 4 * i + j + 1)) for j in range(4)] for i in range(4)]


def fwht4x4(block: Column) -> Column:
    """Of an array of 16 values in rows; columns first."""

    def columns(b: Column) -> Column:
        v = _cells(b)
        done = [_lift([v[i][j] for i in range(4)]) for j in range(4)]
        return F.array(*[done[j][i] for i in range(4) for j in range(4)])

    return _let(_let(block, columns), lambda b: F.array(*[x for row in _cells(b) for x in _lift(row)]))


def iwht4x4(block: Column) -> Column:
    def columns(b: Column) -> Column:
        v = _cells(b)
        done = [_unlift([v[i][j] for i in range(4)]) for j in range(4)]
        return F.array(*[done[j][i] for i in range(4) for j in range(4)])

    return _let(_let(block, lambda b: F.array(*[x for row in _cells(b) for x in _unlift(row)])), columns)


# VP8's 4 x 4 transforms (RFC 6386): fixed-point rotations by an eighth of a half turn, in two passes.

_SIN, _COS = 35468, 20091  # sqrt(2) sin(pi/8) and sqrt(2) cos(pi/8) - 1, times 65536


def _scaled(v: Column, k: int) -> Column:
    return F.shiftright(v * k, 16)


def _turn(v: Sequence[Column]) -> list[Column]:
    low, high = v[0] + v[2], v[0] - v[2]
    c = _scaled(v[1], _SIN) - (v[3] + _scaled(v[3], _COS))
    d = v[1] + _scaled(v[1], _COS) + _scaled(v[3], _SIN)
    return [low + d, high + c, high - c, low - d]


def _hadamard(v: Sequence[Column]) -> list[Column]:
    a, b, c, d = v[0] + v[3], v[1] + v[2], v[1] - v[2], v[0] - v[3]
    return [a + b, c + d, a - b, d - c]


def _columns_then_rows(block: Column, one: Callable[[Sequence[Column]], list[Column]], bias: int) -> Column:
    def columns(b: Column) -> Column:
        v = _cells(b)
        done = [one([v[i][j] for i in range(4)]) for j in range(4)]
        return F.array(*[done[j][i] for i in range(4) for j in range(4)])

    return _let(_let(block, columns), lambda b: F.array(*[F.shiftright(x + bias, 3) for row in _cells(b) for x in one(row)]))


def vp8_idct4x4(block: Column) -> Column:
    return _columns_then_rows(block, _turn, 4)


def vp8_iwht4x4(block: Column) -> Column:
    return _columns_then_rows(block, _hadamard, 3)


def vp8_fdct4x4(block: Column) -> Column:
    """Rows first; the roundings are those that its inverse undoes best."""

    def rows(b: Column) -> Column:
        out = []
        for v in _cells(b):
            a, m, c, d = (x * 8 for x in (v[0] + v[3], v[1] + v[2], v[1] - v[2], v[0] - v[3]))
            out += [a + m, F.shiftright(c * 2217 + d * 5352 + 14500, 12), a - m, F.shiftright(d * 2217 - c * 5352 + 7500, 12)]
        return F.array(*out)

    def columns(b: Column) -> Column:
        v, done = _cells(b), []
        for j in range(4):
            a, m, c, d = v[0][j] + v[3][j], v[1][j] + v[2][j], v[1][j] - v[2][j], v[0][j] - v[3][j]
            done.append([F.shiftright(a + m + 7, 4), F.shiftright(c * 2217 + d * 5352 + 12000, 16) + F.when(d != 0, 1).otherwise(0), F.shiftright(a - m + 7, 4), F.shiftright(d * 2217 - c * 5352 + 51000, 16)])
        return F.array(*[done[j][i] for i in range(4) for j in range(4)])

    return _let(_let(block, rows), columns)


def cos128(angle: int) -> int:
    """4096 times the cosine of ``angle`` 128ths of a half turn, rounded."""
    return int(math.floor(4096 * math.cos(math.pi * (angle % 256) / 128) + 0.5)) if angle % 256 not in (64, 192) else 0


def forward_dct(values: Column, n: int) -> Column:
    """Integer DCT-II of an array of 2^n values, n from 2 to 6, with the basis as literals."""
    if not 2 <= n <= 6:
        raise ValueError("n must be from 2 to 6")
    size, step = 1 << n, 64 >> n
    v = [_long(F.element_at(values, m + 1)) for m in range(size)]

    def total(k: int) -> Column:
        out = F.lit(0).cast("long")
        for m in range(size):
            out = out + v[m] * cos128(step * (2 * m + 1) * k)
        return out

    return F.array(*[round2(total(k) * 2896, 24) if k == 0 else round2(total(k), 12) for k in range(size)])


# 12-bit scale factors of the identity transforms.
_FORWARD_IDENTITY = {2: lambda v: round2(v * 2896, 12), 3: lambda v: round2(v, 1), 4: lambda v: round2(v * 1448, 12), 5: lambda v: round2(v, 2)}
_INVERSE_IDENTITY = {2: lambda v: round2(v * 5793, 12), 3: lambda v: v * 2, 4: lambda v: round2(v * 11586, 12), 5: lambda v: v * 4}


def forward_identity(values: Column, n: int) -> Column:
    return F.transform(values, lambda v: _FORWARD_IDENTITY[n](_long(v)))


def inverse_identity(values: Column, n: int) -> Column:
    return F.transform(values, lambda v: _INVERSE_IDENTITY[n](_long(v)))


def dequant(level: Column, q: Column, denom: int, bit_depth: int) -> Column:
    size = div(F.abs(_long(level) * q).bitwiseAND(F.lit(0xFFFFFF).cast("long")), denom)
    top = 1 << (7 + bit_depth)
    return clip3(-top, top - 1, F.when(level < 0, -size).otherwise(size))


def leb128_len(value: Column) -> Column:
    """Bytes of the unsigned LEB128 form of a value from 0 to 2^63 - 1."""
    return F.greatest(div(F.length(F.bin(_long(value))) + 6, 7), F.lit(1).cast("long")).cast("int")


def leb128(value: Column) -> Column:
    """Those bytes, as binary."""
    n = leb128_len(value)
    digits = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.lpad(F.hex(F.call_function("div", _long(value), F.element_at(F.array(*[F.lit(1 << (7 * j)).cast("long") for j in range(9)]), k + 1)).bitwiseAND(F.lit(127).cast("long")) + F.when(k < n - 1, 128).otherwise(0)), 2, "0"),
    )
    return F.unhex(F.array_join(digits, ""))


def value_to_prefix(value: Column) -> Column:
    """(prefix, extra_bits, extra) of a length or distance from 1 on, as lossless WebP writes it."""
    v = _long(value) - 1
    high = F.length(F.bin(v)) - 1
    second = F.when(F.substring(F.bin(v), 2, 1) == "1", 1).otherwise(0)
    power = F.pow(F.lit(2.0), high - 1).cast("long")
    small = value <= 2
    prefix = F.when(small, v).otherwise(2 * high + second)
    bits = F.when(small, 0).otherwise(high - 1)
    extra = F.when(small, 0).otherwise(v - (2 + second) * power)
    return F.struct(prefix.cast("int").alias("prefix"), bits.cast("int").alias("extra_bits"), extra.cast("long").alias("extra"))


def reverse_bits(value: Column, size: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(_long(value)), size, "0")), 2, 10).cast("long")


def color_index_width_bits(colours: Column) -> Column:
    return F.when(colours <= 2, 3).when(colours <= 4, 2).when(colours <= 16, 1).otherwise(0)


def index_bit_depth(colours: Column) -> Column:
    return F.when(colours <= 2, 1).when(colours <= 4, 2).when(colours <= 16, 4).otherwise(8)


def quality_to_quant(quality: Column) -> Column:
    return div((F.lit(100) - F.least(quality, F.lit(100))) * 127, 100)


def paeth(left: Column, up: Column, corner: Column) -> Column:
    p = left + up - corner
    a, b, c = F.abs(p - left), F.abs(p - up), F.abs(p - corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def row_bytes(samples: Column, bits: int) -> Column:
    return div(samples * bits + 7, 8)


def zlib_header(level: str) -> bytes:
    """CMF and FLG: a 32 KiB window, the level's hint and the check modulo 31."""
    hint = {"store": 0, "fast": 0, "default": 2, "best": 3}[level]
    head = 0x78 << 8 | hint << 6
    return (head + (31 - head % 31) % 31).to_bytes(2, "big")


def fixed_litlen_bits(symbol: Column) -> Column:
    """Code length of a literal or length symbol in DEFLATE's fixed table."""
    return F.when(symbol < 144, 8).when(symbol < 256, 9).when(symbol < 280, 7).otherwise(8)


def deflate_bases(kind: str) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, base) of DEFLATE's length (257 to 285) or distance (0 to 29) codes, by their rule."""
    out, base = [], 3 if kind == "length" else 1
    group = 4 if kind == "length" else 2
    for k in range(28 if kind == "length" else 30):
        extra = max(0, k // group - 1)
        out.append(((257 if kind == "length" else 0) + k, extra, base))
        base += 1 << extra
    return [*out, (285, 0, 258)] if kind == "length" else out


def deflate_code(value: Column, kind: str) -> Column:
    """(symbol, extra_bits, extra) of a length (3 to 258) or distance (1 to 32768): the last base not above it."""
    out = None
    for symbol, extra, base in reversed(deflate_bases(kind)):
        found = F.struct(F.lit(symbol).alias("symbol"), F.lit(extra).alias("extra_bits"), (value - base).cast("int").alias("extra"))
        out = F.when(value >= base, found) if out is None else out.when(value >= base, found)
    return out
